import numpy as np
import pyarrow as pa

from reelloom.llm.wordscan import CHUNK_BYTES, Scan, chunks, hash_words


def test_words_ignore_case_and_marks_between():
    plain = hash_words("the end of äöü жук мир x1")
    for text in ("The END, of ÄÖÜ — Жук «МИР» X1", "the end of…äöü﻿жук　мир_x1"):
        assert np.array_equal(hash_words(text), plain)
    assert len(hash_words("")) == 0 and len(hash_words("... \n—")) == 0
    assert len(set(hash_words("ab ba abc a b").tolist())) == 5


def test_chunks_cover_all_texts():
    texts = ["a b", None, "", "c" * (CHUNK_BYTES + 5), "d\ne f", "g"]
    seen = []
    for first, stop, joined, starts in chunks(pa.array(texts)):
        scan = Scan(joined, starts)
        assert len(starts) == stop - first
        seen += [(first + int(t), scan.data[b:e].tobytes().decode()) for t, b, e in zip(scan.text, scan.begin, scan.end)]
    assert seen == [(0, "a"), (0, "b"), (3, "c" * (CHUNK_BYTES + 5)), (4, "d"), (4, "e"), (4, "f"), (5, "g")]
    assert list(chunks(pa.array([], pa.string()))) == []
