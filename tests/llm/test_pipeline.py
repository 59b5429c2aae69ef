"""Each stage on the rows that the one before kept, against its operator's brute force."""

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from shelfspark.llm import mixing, toxicity
from shelfspark.llm.common import table
from shelfspark.llm.queries import MIX_WEIGHTS
from tests.conftest import SMALL
from tests.llm.test_benchmark import plain_tiles, words
from tests.llm.test_mixing import plan
from tests.llm.test_simhash import slow_groups, slow_print


def test_stages(spark):
    docs = table(spark, SMALL, "documents")
    names = docs.columns
    kept = docs.collect()
    for name, stage in P.STAGES:
        df = spark.createDataFrame(kept, docs.schema)
        out = stage(spark, df, SMALL)
        rows = out.collect()
        if name == "toxicity":
            model = toxicity.fit(docs, table(spark, SMALL, "labels"))
            scores = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
            want = [r for r in kept if scores[r["doc_id"]] < 0.5]
        elif name == "simhash":
            groups = slow_groups({r["doc_id"]: slow_print(r["text"]) for r in kept})
            want = [r for r in kept if groups[r["doc_id"]] == r["doc_id"]]
        elif name == "decontamination":
            items = [words(r["text"]) for r in table(spark, SMALL, "benchmark").collect()]
            grams = [{tuple(w[k:k + 5]) for k in range(len(w) - 4)} for w in items]
            want = []
            for r in kept:
                text = words(r["text"])
                mine = {tuple(text[k:k + 5]) for k in range(len(text) - 4)}
                if not any(len(mine & g) > 1 and plain_tiles(text, w) >= 0.5 * len(w) for w, g in zip(items, grams)):
                    want.append(r)
        elif name == "mixing":
            slim = []
            for r in kept:
                number = int(r["source"][3:])
                domain = "web" if number < 10 else "books" if number < 16 else "forums"
                slim.append((r["doc_id"], domain, r["lang"], r["source"], len(r["text"].split())))
            import tests.llm.test_mixing as M
            before, M.WEIGHTS = M.WEIGHTS, MIX_WEIGHTS
            copies = plan(slim, sum(r[4] for r in slim), mixing.MAX_EPOCHS)
            M.WEIGHTS = before
            by_id = {r["doc_id"]: r for r in kept}
            want = [by_id[r[0]] for r, n in copies.items() for _ in range(n)]
        else:
            plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            lengths = sorted((r["doc_id"], len(plain.encode(r["text"], add_special_tokens=False).ids) + 1) for r in kept)
            assert sorted((r["doc_id"], r["n_tokens"]) for r in rows) == lengths
            assert sorted(r["start"] for r in rows) == [sum(n for _, n in lengths[:i]) for i in range(len(lengths))]
            break
        assert out.columns == names
        assert sorted(map(str, rows)) == sorted(map(str, want)), name
        # the smallest labels hold too few toxic rows to reject any
        assert name == "toxicity" or len(rows) != len(kept), f"{name} decides nothing"
        kept = rows


def test_run(spark):
    assert P.run(spark, SMALL).count() > 0


def test_empty_and_odd_rows(spark):
    docs = table(spark, SMALL, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", "xx", "odd", 0), (-1, "", "xx", "odd", 0)], docs.schema)
    for frame in (docs.limit(0), docs.limit(20).unionByName(odd)):
        df = frame
        for _, stage in P.STAGES:
            df = stage(spark, df, SMALL)
            df = spark.createDataFrame(df.collect(), df.schema)
        assert (df.count() == 0) == (frame.count() == 0)
