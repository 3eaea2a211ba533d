import numpy as np

import corpus_pipeline as cp
from llm import common, langid, pieces, pii, registry
from tests.llm import brute
from tests.llm.test_ops import plain_windows


def test_stages_against_plain(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, None, "x", None), (9002, "", "en", "x", 0), (9003, "12 34 !!", None, None, 8), (9004, "Write to a.b@example.org or +1 555 123 4567 in the then", "en", "x", 1)], docs.schema)
    docs = docs.unionByName(extra)
    rows = {r.doc_id: r.text for r in docs.collect()}
    got, kept = docs, dict(rows)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    coder = pieces.Coder(pieces.load())
    for k, (name, stage) in enumerate(cp.STAGES):
        got = stage(spark, got, sf_dir)
        got.write.parquet(str(tmp_path / str(k)))
        got = spark.read.parquet(str(tmp_path / str(k)))
        if name == "language_id":
            found = {r.doc_id: r for r in langid.identify(docs, langid.fit(docs)).collect()}
            kept = {i: t for i, t in kept.items() if found[i].lang_pred != "und" and found[i].score >= cp.LANGUAGE_SCORE}
            assert {9001, 9002, 9003}.isdisjoint(kept) and len(kept) > 190
        elif name == "ngram_jaccard":
            kept = {d: kept[d] for d, _, c in brute.jaccard_components(sorted(kept.items())) if d == c}
        elif name == "decontamination":
            kept = {d: kept[d] for d, *_, hit in plain_windows(sorted(kept.items()), items) if not hit}
        elif name == "pii":
            kept = {i: pii.redact(t, pii.find(t)) for i, t in kept.items()}
            assert "<EMAIL>" in kept[9004] and "555" not in kept[9004]
        else:
            assert {r.doc_id: r.ids for r in got.collect()} == {i: np.frombuffer(coder.encode(t), np.int32).tolist() for i, t in kept.items()}
            break
        assert {r.doc_id: r.text for r in got.collect()} == kept, name
        assert got.columns == docs.columns
    assert cp.run(spark, sf_dir).count() == len(kept) - 1 and registry.QUERIES["pipeline"] is cp.run and cp.ORACLE_SQL is None


def test_near_copies_of_one_id(spark):
    t = "one two three four five six seven eight nine ten " * 3
    d = spark.createDataFrame([(1, t), (1, t), (2, t + "x"), (3, "other words"), (3, "quite another text"), (None, t), (None, None)], "doc_id long, text string")
    got = cp.drop_near_copies(spark, d, "")
    assert sorted(((r.doc_id or 0), r.text or "") for r in got.collect()) == sorted([(0, ""), (0, t), (1, t), (3, "other words"), (3, "quite another text")])


def test_columns_with_clashing_names(spark, sf_dir):
    names = ["gone", "Gone_Key", "gone_doc", "text_key", "key", "doc", "h", "g", "w", "v", "m", "len", "at", "sid", "tid", "n", "component", "id", "host", "lang_pred", "score", "ids", "r", "of", "spans", "hot", "df", "__text"]
    t = "the house stands on a long road and nobody walks there but one old man who sings in the morning "
    rows = [(i, t * 3 + f"number {i // 2} of all things that I have seen {'again ' * (i % 5)}", "en", *[f"{n}{i}" for n in names]) for i in range(20)] + [(3, t * 3 + "number 1 of all things that I have seen again again again ", "en", *[f"{n}3" for n in names]), (50, "12 34", "en", *names), (51, None, None, *names)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, {', '.join(f'`{n}` string' for n in names)}")
    plain = docs.select("doc_id", "text", "lang")
    for name, stage in cp.STAGES[:-1]:
        new, plain = stage(spark, docs, sf_dir), stage(spark, plain, sf_dir)
        assert new.columns == docs.columns
        docs = spark.createDataFrame(new.collect(), docs.schema)
        assert sorted(map(tuple, docs.select("doc_id", "text", "lang").collect())) == sorted(map(tuple, plain.collect())), name
        assert all(r[n] == f"{n}{r.doc_id}" for r in docs.collect() for n in names)
    assert 0 < docs.count() < 20
    assert cp.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()


def test_only_the_last_table_stays(spark, sf_dir):
    before = common.mark()
    out = cp.run(spark, sf_dir)
    assert len(common._made) - before == 1 and out.count() > 0


def test_no_rows(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        d = stage(spark, d, sf_dir)
    assert d.collect() == []
