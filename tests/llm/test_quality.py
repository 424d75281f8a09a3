import itertools
import random

import numpy as np

from reelloom.llm.quality import SIZES, STATES, Model, document_quality, supposed

PROSE = "The captain meets a widow in the harbor, and neither of them speaks of the storm again. It was the first time that she had seen him smile. "
SAMPLES = {
    "prose": [PROSE * 3, "Der Film ist gut, auch wenn die letzten Minuten etwas zu lang sind und die Musik nicht passt.", "Это тихий фильм о вине, который не торопит своих героев, и в нём есть место для всех.", "i think they cut about three minutes from this and you can tell because the sound jumps", "A heading\n\n" + PROSE * 2 + "\n- one\n- two", "\n".join(PROSE[i : i + 60] for i in range(0, 120, 60))],
    "list": ["\n".join(f"{i}. The Storm of the Mill ({1990 + i})" for i in range(9)), "\n".join(f"- Silent River {i}" for i in range(9)), "\n".join(f"S01E0{i} Night and Garden" for i in range(9)), "\n".join(f"/show/season/show.{i}.mkv" for i in range(9))],
    "table": ["\n".join(f"| Storm | {1990 + i} | 720p | {i} |" for i in range(9)), "\n".join(f"Storm\t{1990 + i}\t720p\t{i}" for i in range(9)), "\n".join(f"Storm            {1990 + i}    720p    {i}" for i in range(9)), "\n".join(f"Baker ...... Night {i}" for i in range(9))],
    "junk": ["\n".join("^#▒▒+/▒|<.<.-+~ _+ ▓░" for _ in range(9)), "\n".join("LFUfDMXmoL2+uZD5NkqftPovrzi2IObFEMG6tiq4BBWVVKJbU7eQdtLi" for _ in range(9)), "guard trust chart lantern river captain wild mask. " * 12, "\n".join("DOWNLOAD NOW!!! 4 >>>" for _ in range(9))],
}


def test_kinds(spark):
    flat = [(kind, text) for kind, texts in SAMPLES.items() for text in texts] * 3
    docs = spark.createDataFrame([(i, t, 1, "x") for i, (_, t) in enumerate(flat)], "doc_id bigint, text string, words int, lines string")
    out = {r.doc_id: r for r in document_quality(docs).collect()}
    for i, (kind, text) in enumerate(flat):
        got = out[i]
        assert abs(got.prose + got.list + got.table + got.junk - 1) < 1e-9
        assert (got.prose > 0.5) == (kind == "prose"), (text[:60], got)


def test_statistics(spark):
    docs = spark.createDataFrame([(1, "The cat sat.\nNo end"), (2, ""), (3, None), (4, " \n\t\n"), (5, "a" * 300_000), (6, PROSE * 3000)], "doc_id bigint, text string")
    out = {r.doc_id: r for r in document_quality(docs).collect()}
    assert len(out) == 6
    assert (out[1].word_count, out[1].punctuated_lines, out[1].symbol_ratio) == (5, 0.5, 1 / 15)
    assert abs(out[1].mean_word_length - 14 / 5) < 1e-9
    for i in (2, 3, 4):
        assert (out[i].word_count, out[i].prose, out[i].list, out[i].table, out[i].junk) == (0, 0, 0, 0, 0)
    assert out[5].junk == 1 and out[6].prose == 1
    assert document_quality(docs.limit(0)).count() == 0


def test_labels_are_the_most_likely():
    rng = np.random.default_rng(3)
    top = int(np.prod(list(SIZES.values())))
    model = Model({n: np.log(rng.dirichlet(np.ones(s), len(STATES))) for n, s in SIZES.items()}, np.log(rng.dirichlet(np.ones(len(STATES)), len(STATES))), np.log(rng.dirichlet(np.ones(len(STATES)))))
    lengths = np.array([3, 0, 1, 4])
    symbols = rng.integers(0, top, lengths.sum())
    found = model.label(symbols, lengths)
    at = 0
    for n in lengths:
        emit = model.scores(symbols[at : at + n])
        score = lambda path: sum(emit[i, s] for i, s in enumerate(path)) + model.first[path[0]] + sum(model.step[a, b] for a, b in zip(path, path[1:]))
        if n:
            best = max(itertools.product(range(len(STATES)), repeat=int(n)), key=score)
            assert abs(score(tuple(found[at : at + n])) - score(best)) < 1e-9
        at += n
    assert random is not None


WRAPPED = "\n".join(f"- Silent River and the {w} of the\n  Long Night ({1990 + i})" for i, w in enumerate(("Mill", "Dam", "Storm", "Ferry", "Garden", "Tower", "Island", "Harbor")))
INSIDE = PROSE * 4 + "\n" + "\n".join(f"| Storm | {1990 + i} | 720p |" for i in range(5)) + "\n" + PROSE * 4


def test_context(spark):
    """Lines that alone look like something else: the second lines of wrapped
    entries, and a table inside prose."""
    flat = [t for texts in SAMPLES.values() for t in texts] * 3
    docs = spark.createDataFrame(list(enumerate([WRAPPED, INSIDE, *flat])), "doc_id bigint, text string")
    out = {r.doc_id: r for r in document_quality(docs).collect()}
    assert out[0].list > 0.9, out[0]
    assert out[1].prose > 0.5 and 0.05 < out[1].table < 0.4, out[1]


def test_supposed_shares_are_shares():
    emission, step, first = supposed()
    for table in (*emission.values(), step, first[None]):
        assert np.allclose(table.sum(axis=1), 1) and (table > 0).all()
