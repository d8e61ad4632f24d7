"""Diffs of many documents at once against the standard library's."""

import difflib
import random

import pytest

from galley import align
from galley.operators import revision


def versions(seed, sizes):
    rng = random.Random(seed)
    out = {}
    for doc, size in enumerate(sizes):
        old = [rng.choice(["", "общая строка", f"абзац {i}", f"абзац {i}"]) for i in range(size)]
        new = list(old)
        for _ in range(rng.randint(0, 1 + size // 12)):
            kind, at = rng.choice("idrm"), rng.randrange(len(new) + 1)
            if kind == "i":
                new[at:at] = [f"вставка {rng.randint(0, 3)}"]
            elif kind == "d":
                del new[at : at + rng.randint(1, 3)]
            elif kind == "r" and at < len(new):
                new[at] = new[at].upper()
            elif kind == "m" and at + 2 < len(new):
                piece, new[at : at + 2] = new[at : at + 2], []
                there = rng.randrange(len(new) + 1)
                new[there:there] = piece
        out[doc] = (old, new)
    return out


def frames(spark, texts):
    rows = lambda side: [(d, 7 * i + 3, t) for d, pair in texts.items() for i, t in enumerate(pair[side])]
    schema = "doc_id long, idx int, text string"
    return spark.createDataFrame(rows(0), schema).repartition(3), spark.createDataFrame(rows(1), schema).repartition(3)


def as_lines(rows):
    """Lines of a unified diff, made from the operator's rows."""
    hunks = {}
    for r in sorted(rows, key=lambda r: r.place):
        hunks.setdefault(r.hunk, []).append(r.op + r.text)
    return [hunks[h] for h in sorted(hunks)]


def unified(old, new):
    hunks = []
    for line in list(difflib.unified_diff(old, new, lineterm=""))[2:]:
        if line.startswith("@@"):
            hunks.append([])
        else:
            hunks[-1].append(line)
    return hunks


def test_diff_equals_the_unified_diff(spark, blocks):
    texts = versions(1, [0, 1, 5, 12, 40, 40, 90, 260, 300])
    texts[50] = (["один", "два"], [])
    texts[51] = ([], ["один", "два"])
    got = {}
    for r in revision.revision_diff(*frames(spark, texts)).collect():
        got.setdefault(r.doc_id, []).append(r)
    for doc, (old, new) in texts.items():
        assert as_lines(got.get(doc, [])) == unified(old, new), doc


@pytest.mark.parametrize("region", [1, 4, 30])
def test_large_documents_are_cut_into_regions(spark, region):
    texts = versions(2, [0, 3, 30, 70, 150])
    # Lines that occur once keep their order, so the runs find what a diff finds.
    texts[9] = ([f"строка {i}" for i in range(200)], [f"строка {i}" for i in range(200) if i % 40 != 7])
    old, new = frames(spark, texts)
    number = lambda frame, name: frame.selectExpr("doc_id", f"CAST((idx - 3) / 7 AS LONG) AS {name}", "text")
    script = align.edit_script(number(old, "i"), number(new, "j"), region).collect()
    for doc, pair in texts.items():
        lines = sorted((r for r in script if r.doc_id == doc), key=lambda r: r.place)
        assert [r.text for r in lines if r.op != "+"] == pair[0]
        assert [r.text for r in lines if r.op != "-"] == pair[1]
        assert len({r.place for r in lines}) == len(lines)
    assert sum(r.doc_id == 9 and r.op != " " for r in script) == 5
