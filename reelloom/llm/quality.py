"""Per-document text quality statistics.

Every line becomes one symbol made of small features (length, common words,
capitals, markers, separators, letters, oddities, ending). A hidden Markov
model with states for prose, lists, tables and junk labels the lines of each
document; shares of the labels, weighted by characters, tell what a document
mostly is.

The model starts from what is supposed of each state's lines, feature by
feature, and is fitted by Viterbi training: its labels of all lines, together
with what was supposed, give the next model. No line is labelled by a rule.
Lines are counted by symbol, so a round ships only the symbol counts of each
task to the driver, a table bounded by the number of symbols, not by the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelloom.llm.wordscan import Scan, chunks, hash_words
from reelloom.session import materialize

KINDS = ("prose", "list", "table", "junk")
# States and their kinds: kinds of several looks have several states.
STATES = ("prose", "marked list", "plain list", "cells", "sheet", "loose words", "code", "page words", "inline list", "repeated line")
KIND_OF = np.array([0, 1, 1, 2, 2, 3, 3, 3, 1, 3])
ROUNDS = 2
# Common words of several languages.
COMMON = (
    "the of and to in is it that for was on are with as be this have from or an by not but what all were when we there can which their if "
    "will each about how up out them then she many some so these would into has her more two him see no my than been who its now did get "
    "at his he i you your they our me do does one only just because after before until where while never any other over until us both "
    "der die das und ist in den von zu mit sich des auf für nicht ein eine einer eines dem im es als auch an er sie wie so aus bei nach "
    "hat nur noch über man aber wenn war wird sind oder einem einen zum zur sehr mir ihm ihr ich wir was doch mehr nichts immer bis "
    "le la les des et en un une du que qui dans est pour pas sur au par plus ne se ce il elle on son sa ses avec mais ou nous vous leur "
    "même fait été aux cette comme tout sans si très ni rien jamais quand où l d c n j qu s a y "
    "el los las de y que en un una del con por para se su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre "
    "también me hasta hay donde quien desde todo nos todos uno ni nada él ella es fue aunque no "
    "и в не на я быть он с что а по это она этот к но они мы весь который из у то за свой от так о для ты же все год мочь вы человек "
    "такой его только или бы себя один как уже до при её их был была ни нет если ещё где когда после чтобы ему ей "
    "хотя можно было быть тот та те кому кто здесь там тут потом очень много мало всё всех ничего никто через между перед под над без про "
    "пока чем этого этой этом эти эта которого которой которую которые меня мне тебя тебе нам нас вам вас им ими своих своей свою даже лишь "
    "ведь вот да ну раз два три одна одно другой самый каждый вся совсем почти снова теперь тогда всегда никогда иногда некоторые есть будет "
    "tras aún esa ese eso estos estas otra otro otros cada tan tanto mucho mucha poco hacia durante contra mientras porque mismo misma era eran ser "
    "ces dont leurs notre votre ils elles encore toujours après avant depuis pendant entre contre chez là où déjà peu trop beaucoup chaque quelque autre "
    "dann hier dort schon selbst gegen ohne unter zwischen während weil damit diese dieser dieses jede jeder kein keine mein dein sein ihre alle viel "
    "nella sono stato suo sua loro anche quando perché dopo prima ogni molto questo quella sem seu sua mas quando depois muito isso essa pelo pela "
    "il di che è per non sono con si da come anche più ma gli nel della dei una lo questo o os um uma não do da em para com se mais "
    "het een van dat niet op te zijn voor met i w na do nie się jest że jak och att det som på är av till för inte bir ve bu da için"
)
# Labels and buttons of pages.
PAGE_WORDS = "home login register contact terms share report rss movies shows next page back top click here download now watch online free hd stream subtitles full"

_ASCII = np.zeros(256, dtype=np.uint8)
_LETTER, _DIGIT, _BLANK, _SYMBOL, _HIGH = 1, 2, 3, 4, 5
_ASCII[:] = _SYMBOL
_ASCII[[*range(65, 91), *range(97, 123)]] = _LETTER
_ASCII[48:58] = _DIGIT
_ASCII[[9, 10, 11, 12, 13, 32]] = _BLANK
_ASCII[128:] = _HIGH
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".!?"]] = True
# Feature sizes, from the least significant place of a symbol on.
# Length and common words count as one: long lines without any are no prose.
SIZES = {"wording": 16, "capitals": 3, "marker": 5, "separators": 4, "letters": 3, "oddity": 6, "ending": 2, "commas": 2}


def _per(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, values, minlength=n) if len(values) else np.zeros(n)


class Lines:
    """Features of the non-blank lines of joined texts."""

    def __init__(self, joined: bytes, starts: np.ndarray, common: np.ndarray, page: np.ndarray):
        scan = Scan(joined, starts)
        data, kind = scan.data, _ASCII[scan.data]
        edges = np.flatnonzero(data == 10)
        begin = np.concatenate([[0], edges[:-1] + 1])
        line_of = lambda at: np.searchsorted(edges, at)
        n = len(edges)

        def count(mask: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(mask)])
            return (total[edges] - total[begin]).astype(np.float64)

        lead = (data & 0xC0) != 0x80  # first bytes of characters
        high = lead & (kind == _HIGH)
        symbols_high = high & ~scan.mask
        letters = count(kind == _LETTER) + count(high & scan.mask)
        digits = count(kind == _DIGIT)
        blanks = count(kind == _BLANK)
        chars = count(lead)
        solid = np.maximum(chars - blanks, 1)
        # Words by white space, for their length, and by letters, for all else.
        word = line_of(scan.begin)
        words = _per(np.ones(len(word)), word, n)
        hashes = scan.hashes
        first = data[scan.begin]
        upper_first = (first >= 65) & (first <= 90)
        second = data[np.minimum(scan.begin + 1, len(data) - 1)]
        shouted = upper_first & (second >= 65) & (second <= 90)
        known = np.isin(hashes, common)
        commons = _per(known.astype(float), word, n)
        pages = _per(np.isin(hashes, page).astype(float), word, n)
        title = _per((upper_first & ~shouted & ~known).astype(float), word, n)
        lower = _per(((first >= 97) & (first <= 122) & ~known).astype(float), word, n)
        shouts = _per(shouted.astype(float), word, n)
        numeric = _per(((first >= 48) & (first <= 57)).astype(float), word, n)
        longest = np.zeros(n)
        solid_edge = np.diff((kind != _BLANK).view(np.int8), prepend=0, append=0)
        a, b = np.flatnonzero(solid_edge == 1), np.flatnonzero(solid_edge == -1)
        tokens = line_of(a)
        np.maximum.at(longest, tokens, (b - a).astype(float))
        # Repetition: distinct words of a line.
        pairs = np.unique(np.stack([word.astype(np.uint64), hashes]), axis=1)[0].astype(np.int64) if len(word) else np.empty(0, np.int64)
        distinct = _per(np.ones(len(pairs)), pairs, n)
        commas = count(data == ord(","))
        following = data[np.minimum(np.arange(1, len(data) + 1), len(data) - 1)]
        tight = ((data == ord(";")) | (data == ord(","))) & (following > 32)
        cells = np.maximum.reduce([count(data == ord("|")), count(data == 9), count(tight)])
        # Marks between entries of an inline list: the next word has a capital.
        mark = np.flatnonzero(np.isin(data[:-3], [ord(c) for c in ",;/"]) & (data[1:-2] == 32))
        titled = (data[mark + 2] >= 65) & (data[mark + 2] <= 90) & (data[mark + 3] >= 97) if len(mark) else np.empty(0, bool)
        marked = _per(np.ones(len(mark)), line_of(mark), n)
        titled = _per(titled.astype(float), line_of(mark), n)
        inline = (marked >= 2) & (titled >= 0.7 * marked) & (words < 8 * (marked + 1))
        two_blanks = (data[:-2] == 32) & (data[1:-1] == 32) & (data[2:] != 32)
        gaps = count(np.concatenate([two_blanks & (np.concatenate([[10], data[:-3]]) != 10), [False, False]]))
        dots = count(np.concatenate([(data[:-3] == 46) & (data[1:-2] == 46) & (data[2:-1] == 46) & (data[3:] == 46), [False] * 3]))
        marks = count(np.concatenate([(data[:-1] == 0xC3) & ((data[1:] == 0x90) | (data[1:] == 0x91) | (data[1:] == 0x83) | (data[1:] == 0x82) | (data[1:] == 0xA2)), [False]]))

        # The first characters of a line.
        start = begin.copy()
        for _ in range(4):
            start = np.where((kind[np.minimum(start, len(data) - 1)] == _BLANK) & (start < edges), start + 1, start)
        peek = lambda k: data[np.minimum(start + k, len(data) - 1)]
        is_digit = lambda x: (x >= 48) & (x <= 57)
        c0, c1, c2, c3 = (peek(k) for k in range(4))
        bullet = (np.isin(c0, [ord(c) for c in "-*+#"]) & (c1 == 32)) | ((c0 == 0xE2) & np.isin(c1, [0x80, 0x97, 0x96, 0x9C]) & np.isin(c2, [0xA2, 0xA3, 0x93, 0x94, 0x8F, 0x8B, 0xAA, 0xAB, 0xA0, 0xA6]) & (c3 == 32))
        closing = lambda c: (c == ord(".")) | (c == ord(")")) | (c == ord(":")) | (c == ord("]"))
        number = (is_digit(c0) & closing(c1) & (c2 == 32)) | (is_digit(c0) & is_digit(c1) & closing(c2) & (c3 == 32)) | (is_digit(c0) & is_digit(c1) & is_digit(c2) & closing(c3))
        number |= (((c0 >= 97) & (c0 <= 122)) | (c0 == 40)) & closing(c1) & (c2 == 32)
        episode = ((c0 | 32) == ord("s")) & is_digit(c1) & is_digit(c2) & ((c3 | 32) == ord("e"))
        path = (np.isin(c0, [ord("/"), ord("\\"), ord("~")]) | ((c0 == ord("m")) & (c1 == ord("a")) & (c2 == ord("g")) & (c3 == ord("n")))) & (longest > 12) | (longest > 60)
        colon = np.concatenate([(data[:-1] == ord(":")) & (data[1:] == 32), [False]])
        first_colon = np.full(n, 1 << 30)
        at = np.flatnonzero(colon)
        np.minimum.at(first_colon, line_of(at), at)
        sheet = (first_colon - begin < 24) & (words <= 14) & (commons <= 2)
        marker = np.select([bullet | number, episode, path, sheet], [1, 2, 3, 4], 0)
        separators = np.select([cells >= 2, (gaps >= 2) | (dots > 0), inline], [1, 2, 3], 0)

        share = commons / np.maximum(words, 1)
        capital = title / np.maximum(words - commons - shouts - numeric, 1)
        # The same words as the line before or after, numbers aside.
        numbered = np.concatenate([[0], np.cumsum(kind == _DIGIT)])
        plain = np.where(numbered[scan.end] > numbered[scan.begin], np.uint64(0), hashes)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(plain, dtype=np.uint64)])
        bounds = np.searchsorted(word, np.arange(n + 1))
        said = total[bounds[1:]] - total[bounds[:-1]]
        text = np.searchsorted(starts, begin, side="right") - 1
        twin = (said[1:] == said[:-1]) & (said[1:] != 0) & (text[1:] == text[:-1]) & (words[1:] >= 2)
        repeated = np.concatenate([[False], twin]) | np.concatenate([twin, [False]])
        oddity = np.select(
            [
                marks >= 0.2 * words + 2,
                (longest > 40) & (words <= 6) | (longest > 100),
                (words >= 8) & (distinct < 0.5 * np.minimum(words, 40)) & (share < 0.2),
                repeated & (cells < 2) & (gaps < 2),
                (pages >= 0.6 * words) & (pages > 0),
            ],
            [1, 2, 3, 5, 4],
            0,
        )
        last = edges - 1
        for _ in range(4):  # closing quotes, brackets and blanks
            c = data[np.maximum(last, 0)]
            last = np.where(np.isin(c, [32, 13, ord('"'), ord("'"), ord(")"), ord("*"), ord("_"), ord(">")]) & (last > begin), last - 1, last)
        tail = data[np.maximum(last, 0)]
        ending = (_ENDS[tail] | (tail == 0xA6) | (tail == 0x9D) | (tail == 0x82)) & (edges > begin)

        keep = np.flatnonzero(chars - blanks > 0)
        places = {
            "wording": np.digitize(words, [4, 8, 16]) * 4 + np.digitize(share, [0.02, 0.15, 0.3]),
            "capitals": np.digitize(capital, [0.35, 0.7]),
            "marker": marker,
            "separators": separators,
            "letters": np.digitize(letters / solid, [0.5, 0.75]),
            "oddity": oddity,
            "ending": ending.astype(int),
            "commas": (commas > 0).astype(int),
        }
        symbol, scale = np.zeros(n, dtype=np.int64), 1
        for name, size in SIZES.items():
            symbol += scale * places[name]
            scale *= size
        self.symbol = symbol[keep].astype(np.int32)
        self.weight = solid[keep].astype(np.int32)
        self.text = text[keep]
        self.words, self.common, self.letters = words[keep], commons[keep], letters[keep]
        self.symbols = (solid - letters - digits)[keep]
        self.word_chars = _per(scan.length.astype(float), word, n)[keep]
        self.ending = ending[keep]


def parts(symbol: np.ndarray) -> dict[str, np.ndarray]:
    out, rest = {}, symbol
    for name, size in SIZES.items():
        out[name] = rest % size
        rest = rest // size
    return out


# What is supposed of a state's lines before any is seen: the share of lines
# that have one of some values of a feature. Values not named share the rest.
# For wording the values are (length, common words) pairs of bins.
SUPPOSED = {
    "prose": {"wording": [((2, 3), (2, 3), 0.75), ((1,), (2, 3), 0.1), ((2, 3), (1,), 0.1), ((3,), (0,), 0.0002)], "capitals": [((0,), 0.85), ((1,), 0.12)], "marker": [((0,), 0.95)], "separators": [((0,), 0.93), ((3,), 0.05)], "letters": [((2,), 0.97)], "oddity": [((0,), 0.99)], "ending": [((1,), 0.75)]},
    "marked list": {"wording": [((0, 1), (0, 1, 2, 3), 0.8), ((2,), (0, 1, 2, 3), 0.15)], "marker": [((1,), 0.7), ((2, 3), 0.28)], "separators": [((0,), 0.9)], "oddity": [((0,), 0.9), ((2,), 0.05)], "ending": [((0,), 0.9)]},
    "plain list": {"wording": [((0, 1), (0, 1, 2, 3), 0.95)], "capitals": [((2,), 0.9)], "marker": [((0,), 0.97)], "separators": [((0,), 0.97)], "letters": [((1, 2), 0.97)], "oddity": [((0,), 0.98)], "ending": [((0,), 0.95)]},
    "cells": {"separators": [((1,), 0.98)], "oddity": [((0,), 0.8)], "marker": [((0,), 0.8)]},
    "sheet": {"wording": [((0, 1), (0, 1, 2), 0.9)], "marker": [((4,), 0.6), ((0,), 0.38)], "separators": [((2,), 0.55), ((0,), 0.43)], "oddity": [((0,), 0.97)], "ending": [((0,), 0.9)]},
    "loose words": {"wording": [((3,), (0,), 0.75), ((2, 3), (0, 1), 0.2)], "capitals": [((0,), 0.9)], "marker": [((0,), 0.97)], "separators": [((0,), 0.97)], "oddity": [((3,), 0.4), ((0,), 0.55)], "commas": [((0,), 0.97)]},
    "code": {"oddity": [((1, 2), 0.75), ((0,), 0.22)], "letters": [((0,), 0.5)], "wording": [((0, 1, 2, 3), (0,), 0.95)], "separators": [((0,), 0.8)]},
    "page words": {"oddity": [((4,), 0.97)], "wording": [((0, 1), (0, 1, 2, 3), 0.8)], "separators": [((0,), 0.8)]},
    "inline list": {"separators": [((3,), 0.98)], "commas": [((1,), 0.9)], "oddity": [((0,), 0.97)], "marker": [((0,), 0.9)]},
    "repeated line": {"oddity": [((5,), 0.98)]},
}
STAYING = 0.8  # supposed share of lines that are followed by one of their state
SUPPOSED_LINES = 50.0  # weight of what is supposed, in lines of each state
SUPPOSED_SHARE = 0.25  # and at least this share of the lines the state has


def supposed() -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Shares by feature and state, from state to state, and at the start."""
    emission = {}
    for name, size in SIZES.items():
        table = np.zeros((len(STATES), size))
        for k, state in enumerate(STATES):
            named = np.zeros(size, dtype=bool)
            for entry in SUPPOSED[state].get(name, []):
                values = [a * 4 + b for a in entry[0] for b in entry[1]] if name == "wording" else list(entry[0])
                table[k, values] = entry[-1] / len(values)
                named[values] = True
            rest = 1 - table[k].sum()
            table[k, ~named] = rest / max(1, (~named).sum())
        emission[name] = table / table.sum(axis=1, keepdims=True)
    k = len(STATES)
    step = np.full((k, k), (1 - STAYING) / (k - 1))
    np.fill_diagonal(step, STAYING)
    return emission, step, np.full(k, 1 / k)


class Model:
    """Log probabilities: by feature and state, from state to state, at the start."""

    def __init__(self, emission: dict[str, np.ndarray], step: np.ndarray, first: np.ndarray):
        self.emission, self.step, self.first = emission, step, first

    @classmethod
    def start(cls) -> Model:
        """The model before any line is seen."""
        return cls.fit({}, np.zeros((len(STATES), len(STATES))))

    @classmethod
    def fit(cls, counts: dict[tuple[int, int], int], steps: np.ndarray) -> Model:
        """The likeliest model of labelled lines and of what is supposed."""
        symbol = np.array([s for s, _ in counts], dtype=np.int64)
        state = np.array([k for _, k in counts], dtype=np.int64)
        weight = np.array(list(counts.values()), dtype=np.float64)
        shares, step, start = supposed()
        strength = np.maximum(SUPPOSED_LINES, SUPPOSED_SHARE * np.bincount(state, weight, minlength=len(STATES)))
        emission = {}
        for name, values in parts(symbol).items():
            table = shares[name] * strength[:, None]
            np.add.at(table, (state, values), weight)
            emission[name] = np.log(table / table.sum(axis=1, keepdims=True))
        step = steps + step * strength[:, None]
        # A first line may be of any state: what most documents begin with says nothing of one of a single line.
        return cls(emission, np.log(step / step.sum(axis=1, keepdims=True)), np.log(start))

    def scores(self, symbol: np.ndarray) -> np.ndarray:
        total = np.zeros((len(symbol), len(STATES)))
        for name, values in parts(symbol.astype(np.int64)).items():
            total += self.emission[name].T[values]
        return total

    def label(self, symbol: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Most likely states of the lines of many documents; ``length`` lines
        belong to each. All documents advance in step, longest first."""
        out = np.zeros(len(symbol), dtype=np.int8)
        if not len(symbol):
            return out
        emit = self.scores(symbol)
        head = np.cumsum(length) - length
        order = np.argsort(-length, kind="stable")
        order = order[length[order] > 0]
        head, length = head[order], length[order]
        back = np.zeros((len(symbol), len(STATES)), dtype=np.int8)
        score = self.first + emit[head]
        final = np.zeros(len(order), dtype=np.int8)
        alive = len(order)
        for t in range(1, int(length[0]) + 1):
            now = int(np.searchsorted(-length, -t, side="left"))  # documents with more than t lines
            final[now:alive] = score[now:alive].argmax(axis=1)
            alive = now
            if not alive:
                break
            ways = score[:alive, :, None] + self.step[None]
            at = head[:alive] + t
            back[at] = ways.argmax(axis=1)
            score = ways.max(axis=1) + emit[at]
        state = final.copy()
        for t in range(int(length[0]) - 1, -1, -1):
            now = int(np.searchsorted(-length, -t, side="left"))
            at = head[:now] + t
            out[at] = state[:now]
            state[:now] = back[at, state[:now]]
        return out


def _line_table(documents: DataFrame) -> DataFrame:
    """doc_id, the symbols and weights of its lines, and plain statistics."""
    common = np.unique(np.concatenate([hash_words(w) for w in sorted(set(COMMON.split()))]))
    page = np.unique(hash_words(PAGE_WORDS))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, joined, starts in chunks(batch.column(1)):
                x = Lines(joined, starts, common, page)
                n = stop - first
                length = np.bincount(x.text, minlength=n)
                edges = np.concatenate([[0], np.cumsum(length)])
                cut = lambda values: [values[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]
                add = lambda values: pa.array(_per(np.asarray(values, dtype=float), x.text, n))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), pa.array(cut(x.symbol), pa.binary()), pa.array(cut(x.weight), pa.binary()), pa.array(length.astype(np.int64)), add(x.words), add(x.word_chars), add(x.common), add(x.symbols), add(x.weight), add(x.ending)],
                    ["doc_id", "symbols", "weights", "lines", "words", "word_chars", "common", "marks", "chars", "endings"],
                )

    schema = "doc_id bigint, symbols binary, weights binary, lines bigint, words double, word_chars double, common double, marks double, chars double, endings double"
    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(read, schema)


def _counted(lines: DataFrame, model: Model) -> tuple[dict, np.ndarray]:
    """Lines by symbol and state, and steps, over all documents."""
    k = len(STATES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[int, int] = {}
        for batch in batches:
            symbol = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.int32).astype(np.int64)
            length = batch.column(1).to_numpy()
            state = model.label(symbol, length).astype(np.int64)
            head = np.zeros(len(symbol), dtype=bool)
            head[(np.cumsum(length) - length)[length > 0]] = True
            joined = ~head[1:]
            for code in (symbol * 64 + state, -1 - (state[:-1][joined] * k + state[1:][joined])):
                for c, n in zip(*np.unique(code, return_counts=True)):
                    tally[int(c)] = tally.get(int(c), 0) + int(n)
        yield pa.RecordBatch.from_arrays([pa.array(list(tally), pa.int64()), pa.array(list(tally.values()), pa.int64())], ["code", "n"])

    rows = lines.select("symbols", "lines").mapInArrow(count, "code bigint, n bigint").groupBy("code").agg(F.sum("n")).collect()  # bounded by the symbols
    counts, steps = {}, np.zeros((k, k))
    for code, n in rows:
        if code >= 0:
            counts[(code // 64, code % 64)] = n
        else:
            steps[divmod(-1 - code, k)] += n
    return counts, steps


def document_quality(documents: DataFrame) -> DataFrame:
    """Statistics of each document and the shares of its text by kind.

    doc_id, word_count, mean_word_length, symbol_ratio, punctuated_lines,
    common_words, prose, list, table, junk. Blank and null texts have no words
    and no share of anything. Repeated rows give repeated results.
    """
    lines = materialize(_line_table(documents), "lines")
    model = Model.start()
    for _ in range(ROUNDS):
        model = Model.fit(*_counted(lines, model))
    fitted = model

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbol = np.frombuffer(b"".join(batch.column("symbols").to_pylist()), dtype=np.int32)
            weight = np.frombuffer(b"".join(batch.column("weights").to_pylist()), dtype=np.int32)
            length = batch.column("lines").to_numpy()
            state = fitted.label(symbol, length)
            owner = np.repeat(np.arange(len(length)), length)
            total = np.maximum(_per(weight.astype(float), owner, len(length)), 1)
            shares = [pa.array(_per(weight * (KIND_OF[state] == k), owner, len(length)) / total) for k in range(len(KINDS))]
            get = lambda name: batch.column(name).to_numpy()
            words = np.maximum(get("words"), 1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(get("words").astype(np.int64)),
                    pa.array(get("word_chars") / words),
                    pa.array(get("marks") / np.maximum(get("chars"), 1)),
                    pa.array(get("endings") / np.maximum(length, 1)),
                    pa.array(get("common") / words),
                    *shares,
                ],
                ["doc_id", "word_count", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_words", *KINDS],
            )

    schema = "doc_id bigint, word_count bigint, mean_word_length double, symbol_ratio double, punctuated_lines double, common_words double, " + ", ".join(f"{s} double" for s in KINDS)
    return lines.mapInArrow(label, schema)
