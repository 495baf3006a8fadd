"""Parser edge cases on hand-built block frames and files."""

from pyspark.sql import functions as F

from tessera.operators.metrics import majority_label
from tessera.sources import blocks as B
from tessera.sources import parse as P
from tessera.sources import sinks as K


def blocks_frame(spark, texts, closed=None):
    closed = closed or [True] * len(texts)
    rows = [("f", i, t, c) for i, (t, c) in enumerate(zip(texts, closed))]
    return spark.createDataFrame(rows, "file string, block_no long, block string, closed boolean")


def test_conll2_keeps_hash_tokens_and_placeholders(spark):
    b = blocks_frame(spark, ["#tag\tX\n_\tNOUN\nword\t_", "# comment\nhola\tINTJ"])
    rows = P.parse_conll2(b).orderBy("block_no", "pos").collect()
    assert [(r.word, r.tag) for r in rows] == [("#tag", "X"), ("_", "NOUN"), ("word", "_"), ("hola", "INTJ")]


def test_conllu_multiword_and_empty_nodes(spark):
    line = lambda *f: "\t".join(f)
    block = "\n".join(["# sent_id = 7", "# text = a b",
                       line("1-2", "ab", "_", "_", "_", "_", "_", "_", "_", "_"),
                       line("1", "a", "a", "DET", "_", "_", "2", "det", "_", "_"),
                       line("2", "b", "b", "NOUN", "_", "_", "0", "root", "_", "_"),
                       line("2.1", "c", "c", "X", "_", "_", "_", "_", "_", "_")])
    t = P.parse_conllu(blocks_frame(spark, [block])).orderBy("pos").collect()
    assert [r.id for r in t] == ["1-2", "1", "2", "2.1"]
    assert [r.head for r in t] == [None, 2, 0, None]
    h = P.parse_headers(blocks_frame(spark, [block])).collect()[0].header
    assert h == {"sent_id": "7", "text": "a b"}
    ids = P.extract_header_ids(blocks_frame(spark, [block]), "sent_id").collect()
    assert [r.header_id for r in ids] == ["7"]


def test_parse_lid_headers_spans_unknown_labels(spark):
    b = blocks_frame(spark, ["# sent_enum = 1\nhola\tlang2\nfriend\tlang1",
                             "más\tlang2",  # no header: continues sentence 1
                             "# sent_enum = 2\n😀\tweird\nx y\tother", "meta 3\nmetal\tne"])
    t = P.parse_lid(b).orderBy("sent_no", "pos").collect()
    assert [(r.sent_no, r.pos, r.token) for r in t] == [
        (1, 0, "hola"), (1, 1, "friend"), (1, 2, "más"), (2, 0, "😀"), (2, 1, "x"), (3, 0, "metal")]
    assert [(r.span_start, r.span_end) for r in t[:3]] == [(0, 4), (5, 11), (12, 15)]
    assert t[3].label_idx == -1 and t[3].span_end == 1  # emoji counts one code point
    assert t[4].label == "y"  # U+00A0 is whitespace for the field match


def test_majority_label_tie_goes_to_first_seen(spark):
    toks = spark.createDataFrame([(1, 0, "other"), (1, 1, "lang1"), (1, 2, "lang1"), (1, 3, "other"),
                                  (2, 0, "ne"), (2, 1, "lang2"), (2, 2, "lang2")],
                                 "sent long, pos long, label string")
    got = {r.sent: r.majority_label for r in majority_label(toks, ["sent"]).collect()}
    assert got == {1: "other", 2: "lang2"}


def test_labelled_conll_label_carries_and_dangling_dropped(spark):
    b = blocks_frame(spark, ["# sent_enum = 1\tpositive\nhola\tlang2\nyou\tlang1", "otra\tlang2",
                             "# sent_enum = 3\tnegative\nbad\tlang1\n"], [True, True, False])
    rows = P.parse_labelled_conll(b).orderBy("block_no").collect()
    assert [(r.text, r.label) for r in rows] == [("hola you", "positive"), ("otra", "positive")]
    kept = P.parse_labelled_conll(b, dangling="keep").count()
    assert kept == 3


def test_meta_conll(spark):
    b = blocks_frame(spark, ["meta\t1\tpositive\nhola lang2\nque lang2", "meta 2\nmetafora x"])
    rows = P.parse_meta_conll(b).orderBy("block_no").collect()
    assert [r.text for r in rows] == ["hola que", "metafora"]


def test_scan_blocks_files_double_blank_crlf_dangling(spark, tmp_path):
    (tmp_path / "a.conll").write_text("w1\tX\nw2\tY\n\n\nw3\tZ\n\nw4\tQ\n")
    blocks = B.scan_blocks(spark, str(tmp_path / "a.conll")).orderBy("block_no").collect()
    assert [b.block.strip("\n") for b in blocks] == ["w1\tX\nw2\tY", "w3\tZ", "w4\tQ"]
    assert [b.closed for b in blocks] == [True, True, False]
    (tmp_path / "b.conll").write_bytes(b"a\tX\r\nb\tY\r\n\r\nc\tZ\r\n\r\n")
    crlf = B.scan_blocks(spark, str(tmp_path / "b.conll"), newline="crlf").orderBy("block_no").collect()
    assert [b.block for b in crlf] == ["a\tX\nb\tY", "c\tZ"]


def test_write_conll2_round_trip(spark, tmp_path):
    toks = spark.createDataFrame([(s, p, f"w{s}_{p}", "NOUN" if p % 2 else "VERB")
                                  for s in range(50) for p in range(1 + s % 7)],
                                 "sent_id long, pos long, word string, tag string")
    out = str(tmp_path / "out")
    K.write_conll2(toks, out)
    back = P.parse_conll2(B.scan_blocks(spark, out))
    assert back.count() == toks.count()
    assert back.select("word", "tag").exceptAll(toks.select("word", "tag")).count() == 0
    firsts = back.where(F.col("pos") == 0).count()
    assert firsts == 50
