"""Blocks of growing file groups: pieces cut anywhere, restarts, several drops in one batch."""

import os
import random

import pytest

from tessera.streaming import stateful as S


def blocks_of(text):
    return [b for b in (x.strip("\n") for x in text.replace("\r\n", "\n").split("\n\n")[:-1]) if b]


def test_split_blocks_is_one_reading():
    """However a text is cut, the pieces give its blocks and the same tail."""
    rnd = random.Random(1)
    for _ in range(300):
        text = "".join(rnd.choice(["a", "b\t", "\n", "\n\n", "\r\n", "\r\n\r\n", "é"]) for _ in range(25))
        rest, got, at = "", [], 0
        while at < len(text):
            z = at + rnd.randint(1, 6)
            done, rest = S.split_blocks(rest, text[at:z])
            got += done
            at = z
        assert got == blocks_of(text)


@pytest.mark.parametrize("together", [True, False])
def test_sentence_over_two_drops(spark, tmp_path, together):
    text = {"x": "a\t1\nb\t2\n\nc\t3\nd\t4\n\n\n\ne\t5\n\nunfinished\t6", "y": "only\t1\n\n", "z": "\n\n"}
    cuts = {"x": [0, 10, 11, 20, len(text["x"])], "y": [0, 2, len(text["y"])], "z": [0, 1, 2]}
    src, out, ckpt = (str(tmp_path / d) for d in ("in", "out", "ckpt"))
    run = lambda: S.run_blocks(spark, src, out, ckpt)
    for drop in range(4):
        for g, at in cuts.items():
            if drop + 1 < len(at):
                os.makedirs(f"{src}/grp={g}", exist_ok=True)
                with open(f"{src}/grp={g}/piece-{drop}.txt", "w", newline="") as f:
                    f.write(text[g][at[drop]:at[drop + 1]])
        if not together:
            run()                                   # a new stream per drop, from the checkpoint
    run()
    run()                                           # nothing new: nothing comes out twice
    got = sorted((r.grp, r.sent_no, r.block) for r in spark.read.schema("grp string, sent_no long, block string").parquet(out).collect())
    assert got == [(g, i, b) for g in sorted(text) for i, b in enumerate(blocks_of(text[g]))]
