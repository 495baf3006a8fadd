"""Failure modes and pluggable surfaces: strict lookups, zip length checks, encoders,
stream restarts, text-directory scans, model round trips."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.operators import align as A
from tessera.operators import ml as ML
from tessera.operators import tagger as TG
from tessera.operators import recode as R
from tessera.sources import blocks as B
from tessera.sources import parse as P
from tessera.streaming.resume import resume_stream


def test_zip_join_fails_on_unequal_lengths(spark):
    a = spark.createDataFrame([(1, 0, "x"), (1, 1, "y")], "s long, p long, w string")
    b = spark.createDataFrame([(1, 0, "N")], "s long, p long, t string")
    with pytest.raises(Exception, match="differ in length"):
        A.zip_join(a, b, ["s", "p"]).collect()
    ok = A.zip_join(a, spark.createDataFrame([(1, 0, "N"), (1, 1, "V")], "s long, p long, t string"), ["s", "p"])
    assert ok.count() == 2


def test_strict_tag_lookup_raises_and_lenient_modes(spark):
    df = spark.createDataFrame([("NOUN",), ("BOGUS",)], "tag string")
    with pytest.raises(Exception, match="unknown tag"):
        df.select(R.encode_tag(F.col("tag"))).collect()
    got = [r[0] for r in df.select(R.encode_tag(F.col("tag"), on_unknown="null")).collect()]
    assert got == [8, None]
    got = [r[0] for r in df.select(R.encode_tag(F.col("tag"), on_unknown="value", default=-1)).collect()]
    assert got == [8, -1]
    assert [r[0] for r in spark.createDataFrame([("SYM",), ("CCONJ",), ("ADJ",)], "t string")
            .select(R.normalise_tag(F.col("t"))).collect()] == ["X", "CONJ", "ADJ"]


def test_pluggable_encoder_keeps_good_rows_of_a_failed_batch(spark):
    def make_encoder():
        def predict(texts):
            if any(t.startswith("boom") for t in texts):
                raise RuntimeError("encoder failure")
            return np.stack([np.array([len(t), t.count(" ")], dtype=np.float32) for t in texts])
        return predict

    df = spark.createDataFrame([(1, "a b c"), (2, "hello"), (3, "boom x")], "id long, text string").coalesce(1)
    ML.register_encoder("lengths", make_encoder)
    got = {r.id: (r.vec, r.vec_error) for r in ML.encode_text(df, "text", "vec", encoder="lengths", batch_size=8).collect()}
    assert got[1] == ([5.0, 2.0], None) and got[2] == ([5.0, 0.0], None)
    assert got[3] == (None, "RuntimeError: encoder failure")


def test_resume_stream_processes_each_file_once(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    (src / "a.conll").write_text("# sent_enum = 1\nhola\tlang2\n\n# sent_enum = 2\nhi\tlang1\n\n")

    def parse(b):
        return P.parse_lid(b).select("file", "sent_no", "token")

    resume_stream(spark, str(src), out, ck, parse)
    resume_stream(spark, str(src), out, ck, parse)  # nothing new: no duplicates
    assert spark.read.parquet(out).count() == 2
    (src / "b.conll").write_text("# sent_enum = 1\nyo\tlang2\n\n")
    resume_stream(spark, str(src), out, ck, parse)
    assert sorted(r.token for r in spark.read.parquet(out).collect()) == ["hi", "hola", "yo"]


def test_scan_text_dir_orders_by_path_and_cuts(spark, tmp_path):
    for name in ("c", "a", "b"):
        (tmp_path / f"{name}.txt").write_text(f"doc {name}\nline two")
    (tmp_path / "skip.md").write_text("not a text file")
    got = B.scan_text_dir(spark, str(tmp_path), ".txt", first_n=2).orderBy("ordinal").collect()
    assert [r.text.split("\n")[0] for r in got] == ["doc a", "doc b"]


def test_model_save_load_same_predictions(spark, tmp_path):
    from tessera.sources.sinks import load_model, save_model
    rows = [(i, ("good day " if i % 2 else "bad night ") * (1 + i % 3), str(i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, text string, label string")
    model = ML.train_sequence_classifier(df, "text", "label", max_iter=10)
    save_model(model, str(tmp_path / "m"))
    again = load_model(str(tmp_path / "m"))
    a = [r.prediction for r in model.transform(df).orderBy("id").collect()]
    b = [r.prediction for r in again.transform(df).orderBy("id").collect()]
    assert a == b
    acc = np.mean([float(p) == float(r[2]) for p, r in zip(a, rows)])
    assert acc > 0.9


def test_token_tagger_beats_majority_baseline(spark):
    words = {"NOUN": ["casa", "perro", "house", "dog"], "VERB": ["corre", "runs", "eats", "come"],
             "DET": ["el", "la", "the", "a"]}
    rows = []
    for s in range(60):
        seq = [("DET", words["DET"][s % 4]), ("NOUN", words["NOUN"][(s + 1) % 4]), ("VERB", words["VERB"][s % 4])]
        rows += [(s, p, w, t) for p, (t, w) in enumerate(seq)]
    toks = spark.createDataFrame(rows, "sent_id long, pos long, word string, tag string")
    model = TG.train_tagger(toks)
    pred = TG.predict_tags(model, toks)
    acc = pred.select(F.avg((F.col("gold") == F.col("pred")).cast("double"))).first()[0]
    assert acc > 0.9  # majority baseline is 1/3


def test_predict_similarity_identity_and_disjoint(spark):
    df = spark.createDataFrame([(1, "hola mundo", "hola mundo"), (2, "abc", "xyz"), (3, "ab", "ab")],
                               "k long, a string, b string")
    got = {r.k: r.similarity for r in ML.predict_similarity(df, "k", "a", "b").collect()}
    assert got[1] == pytest.approx(1.0) and got[2] == 0.0 and got[3] is None


_ = PySparkException


def test_longest_match_pieces_rebuild_words(spark):
    from tessera.plans.catalog_ml import subword_align
    vocab = ["un", "##aff", "##able", "##a", "##b", "##l", "##e", "hola", "h", "##o", "##la", "x"]
    toks = spark.createDataFrame([(1, 0, "unaffable", "ADJ"), (1, 1, "hola", "INTJ"), (1, 2, "qq", "X"),
                                  (2, 0, "hola", "INTJ")], "sent_id long, pos long, word string, tag string")
    split = ML.longest_match_pieces(toks, spark.createDataFrame([(p,) for p in vocab], "piece string"))
    s = subword_align(toks, pieces=split).orderBy("sent_id", "pos", "piece_no").collect()
    first = [(r.piece, r.piece_tag, r.is_head) for r in s if r.sent_id == 1 and r.pos == 0]
    assert first == [("un", "ADJ", 1), ("##aff", "<pad>", 0), ("##able", "<pad>", 0)]
    assert [r.piece for r in s if r.pos == 2] == ["[UNK]"]
    assert [r.piece for r in s if r.sent_id == 2] == ["hola"]


def test_delimited_round_trip_keeps_quotes_separators_and_line_ends(spark, tmp_path):
    from tessera.sources.sinks import write_csv, write_delimited
    texts = ['a "quoted" text', "two\nlines", "tab\there", "back\\slash \\n", "cr\rlf\r\n", "", None, " spaces ", "\\", "a,b"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for i, (write, sep) in enumerate([(lambda d, p: write_delimited(d, p), "\t"), (write_csv, ","), (lambda d, p: write_delimited(d, p, "|"), "|")]):
        path = str(tmp_path / f"d{i}")
        write(df, path)
        back = B.scan_delimited(spark, path, "id long, text string", sep=sep, escaped=True)
        assert {r.id: r.text for r in back.collect()} == dict(enumerate(texts))


def test_scans_keep_file_order_over_splits_and_many_files(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    want = []
    for f in (9, 10, 99999, 100000):
        rows = [f"{f}-{i} " + "x" * (i % 7) for i in range(300)]
        (d / f"part-{f}.txt").write_text("".join(r + "\n\n" for r in rows))
        want += rows
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        blocks = B.scan_blocks(spark, str(d))
        got = sorted((int(r.file.rsplit("part-", 1)[1][:-4]), r.block_no, r.block) for r in blocks.collect())
        assert [g[2] for g in got] == want and [g[1] for g in got] == list(range(300)) * 4
        lines = B.scan_lines(spark, str(d)).where("text <> ''").orderBy("line_no").collect()
        assert [r.text for r in lines] == want
        plan = blocks._jdf.queryExecution().executedPlan().toString()
        assert "value" not in "".join(x for x in plan.split("\n") if "Exchange hashpartitioning" in x)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (d / "part-5.txt").write_text("a\n\n\n\nb\n\n")
    assert B.scan_blocks(spark, str(d / "part-5.txt"), keep_empty=True).count() == 3


def test_cluster_without_checkpoint_folder_fails(monkeypatch):
    from types import SimpleNamespace

    from tessera.session import ensure_checkpoint_dir
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://x:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(fake)


def test_unseen_labels_add_no_class(spark):
    rows = [(i, "good day " * 3 if i % 2 else "bad night " * 3, "ab"[i % 2]) for i in range(20)]
    model = ML.train_sequence_classifier(spark.createDataFrame(rows, "id long, text string, label string"), "text", "label", max_iter=5)
    assert sorted(ML.labels_of(model)) == ["a", "b"] and model.stages[-1].numClasses == 2
    out = model.transform(spark.createDataFrame([(1, "good day", "z")], "id long, text string, label string"))
    assert out.select(ML.decode_prediction(model)).first()[0] in ("a", "b")


def test_attach_by_ordinal_fails_on_unequal_lengths(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "ordinal long, a string")
    b = spark.createDataFrame([(0, "N")], "ordinal long, b string")
    with pytest.raises(Exception, match="differ in length"):
        A.attach_by_ordinal(a, b).collect()
    frames = {"en": a.withColumnRenamed("a", "text").withColumnRenamed("ordinal", "line_no"), "es": b.withColumnRenamed("b", "text").withColumnRenamed("ordinal", "line_no")}
    with pytest.raises(Exception, match="differ in length"):
        A.parallel_align(frames).collect()
    assert {tuple(r) for r in A.parallel_align(frames, unmatched="null").collect()} == {(0, "x", "N"), (1, "y", None)}


def test_resume_pairs_fails_on_a_broken_schema(spark, tmp_path):
    from tessera.operators.graphs import resume_pairs
    work = spark.createDataFrame([(1, 2), (2, 3)], "g1 long, g2 long")
    out = str(tmp_path / "done")
    assert resume_pairs(work.limit(1), out, lambda d: d).count() == 1
    assert resume_pairs(work, out, lambda d: d).count() == 2
    broken = str(tmp_path / "broken")
    spark.createDataFrame([(1,)], "other long").write.parquet(broken)
    with pytest.raises(Exception):
        resume_pairs(work, broken, lambda d: d)


def test_meta_blocks_drop_the_dangling_tail(spark):
    b = spark.createDataFrame([("f", 0, "noise x\nmeta 1\na x\nb x", True), ("f", 1, "metadata 2\nc x", True), ("f", 2, "meta 3\nd x\n", False)],
                              "file string, block_no long, block string, closed boolean")
    texts = lambda **k: [r.text for r in P.parse_meta_conll(b, **k).orderBy("block_no").collect()]
    assert texts() == ["a b", "metadata c"] and texts(compat=True) == ["a b", "c"] and texts(dangling="keep")[-1] == "d"
