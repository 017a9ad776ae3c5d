"""The pipeline's stages against plain Python over the same rows."""


import corpus_pipeline
from pyspark.sql import functions as F

from tidemark.llm import decontam, neardup, pii, sptok
from tidemark.llm.spark import table


def test_run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, at, sf_dir)
        assert after.columns == docs.columns and dict(after.dtypes) == dict(docs.dtypes), name
        after = spark.createDataFrame(after.collect(), docs.schema)
        if name == "near_duplicates":
            want = {r["component_id"] for r in neardup.near_duplicates(at).collect()}
            assert sorted(r["doc_id"] for r in after.collect()) == sorted(want)
        elif name == "decontaminate":
            bad = {r["doc_id"] for r in decontam.find_contamination(at, table(spark, sf_dir, "benchmark")).collect()}
            assert bad and {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in at.collect()} - bad
        elif name == "personal_data":
            before = {r["doc_id"]: r["text"] for r in at.collect()}
            for r in after.collect():
                assert r["text"] == pii.redact(before[r["doc_id"]]) and not pii.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
        else:
            assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in at.collect()}  # all are in a language
        at = after
    m = sptok.memory(open(sptok.MODEL, "rb").read())
    want = {r["doc_id"]: (r["lang"], sptok.encode(r["text"], m)) for r in at.collect()}
    got = {r["doc_id"]: (r["lang"], r["ids"]) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want


def test_ids_that_do_not_tell(spark, sf_dir):
    item = table(spark, sf_dir, "benchmark").orderBy("item_id").first()["text"]
    plain = "Nine grey herons watched the slow river turn silver under an early winter moon near the old mill"
    rows = [(-1, item), (-1, plain), (None, "Here it is: " + item), (None, "lone words that nobody else has written down anywhere")]
    docs = table(spark, sf_dir, "documents")
    at = spark.createDataFrame([(i, t, "en", "x", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").select([F.col(f.name).cast(f.dataType) for f in docs.schema])
    at = corpus_pipeline.near_duplicates(spark, at, sf_dir)
    got = corpus_pipeline.decontaminate(spark, at, sf_dir)
    assert got.columns == docs.columns and {(r["doc_id"], r["text"]) for r in got.collect()} == {rows[1], rows[3]}


CLASHING = ("row", "letter", "score", "known", "lang_pred", "grams", "digest", "key", "bits", "root", "n")


def test_stages_on_odd_rows(spark, sf_dir):
    """Nulls, repeated rows and ids, ties, long texts and columns named like the operators' own pass every stage."""
    item = table(spark, sf_dir, "benchmark").orderBy("item_id").first()["text"]
    plain = "Nine grey herons watched the slow river turn silver under an early winter moon near the old mill"
    long = " ".join(f"the word {i * 7919 % 9973} of a long tale" for i in range(9000))
    rows = [
        (1, plain, "en"), (1, plain, "en"), (2, plain, None), (None, plain, None), (3, None, "en"), (None, None, None), (4, "", None), (5, long, "en"), (6, item, "en"), (None, item, None),
        (7, "Please write to the harbour master at old.mill@example.org about the boats and the river", None), (8, "12 34", "de"),
    ]
    docs = table(spark, sf_dir, "documents")
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    odd = spark.createDataFrame([(i, t, lang, None, None, *CLASHING) for i, t, lang in rows], schema).select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in docs.schema], *[F.col(f"`{c}`") for c in CLASHING])
    at = docs.withColumns({c: F.lit(c) for c in CLASHING}).unionByName(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, at, sf_dir)
        assert after.columns == at.columns and dict(after.dtypes) == dict(at.dtypes), name
        after = spark.createDataFrame(after.collect(), at.schema)
        mine = lambda x: sorted((str(r["doc_id"]), r["text"] or "") for r in x.collect() if any(r["text"] == t and r["doc_id"] == i for i, t, _ in rows) or "[email]" in (r["text"] or "") and "harbour master" in r["text"])
        if name == "language":
            assert mine(after) == sorted((str(i), t) for i, t, _ in rows if t and t != "12 34")
        if name == "near_duplicates":
            assert mine(after) == sorted([("1", plain), ("5", long), ("7", rows[10][1]), *(x for x in mine(after) if x[1] == item)]) and sum(x[1] == item for x in mine(after)) <= 1
        if name == "decontaminate":
            assert [x[0] for x in mine(after)] == ["1", "5", "7"]
        if name == "personal_data":
            assert ("7", rows[10][1].replace("old.mill@example.org", "[email]")) in mine(after)
        assert all([r[c] for c in CLASHING] == list(CLASHING) for r in after.collect())
        at = after
    last = corpus_pipeline.STAGES[-1][1](spark, at, sf_dir).collect()
    m = sptok.memory(open(sptok.MODEL, "rb").read())
    assert max((r["ids"] for r in last if r["doc_id"] == 5), key=len) == sptok.encode(long, m)


def test_rejected(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    odd = docs.limit(3).withColumns({"doc_id": F.col("doc_id") + 1_000_000, "text": F.element_at(F.array(F.lit(""), F.lit("12 34"), F.lit(None)), (F.col("doc_id") % 3 + 1).cast("int"))})
    got = corpus_pipeline.language(spark, docs.unionByName(odd), sf_dir)
    assert got.where("doc_id >= 1000000").count() == 0 and got.count() == docs.count()


def test_short(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    short = docs.limit(3).withColumns({"doc_id": F.col("doc_id") + 1_000_000, "text": F.element_at(F.array(F.lit("A."), F.lit("y"), F.lit("Ok")), (F.col("doc_id") % 3 + 1).cast("int"))})
    assert corpus_pipeline.language(spark, docs.unionByName(short), sf_dir).where("doc_id >= 1000000").count() == 3


def test_other_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [
        (-1, "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.", "fi", "x", 1),
        (-2, "Все люди рождаются свободными и равными в своем достоинстве и правах.", "ru", "x", 1),
        (-3, "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.", None, "x", 1),
    ]
    foreign = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select([F.col(f.name).cast(f.dataType) for f in docs.schema])
    # learned from docs alone: one document is too few to make a language, so its own n-grams are no filter
    got = corpus_pipeline.language(spark, docs.unionByName(foreign), sf_dir)
    assert got.where("doc_id < 0").count() == 0 and got.count() == docs.count()


def test_empty(spark, sf_dir, tmp_path):
    for name in ("documents", "benchmark"):
        table(spark, sf_dir, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
