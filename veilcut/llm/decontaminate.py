"""Benchmark decontamination by template canonicalisation.

Tokens are words without outer punctuation, ASCII letters lower-cased; numbers, names and units become typed
placeholders.  Every window of `width` template tokens of a document is hash-joined with the template windows
of the benchmark; where both sides have placeholders, the slots must correspond one to one (equal values on
one side are equal on the other, different ones different), so `Ann has 3 apples, Bob has 5` matches `Eve
has 7 apples, Tom has 2` and not `Eve has 7 apples, Eve has 7`.  A document with a consistent window is contaminated.

A name is a word with one capital in front that doesn't start a sentence, or a known given name anywhere; a
number consists of digits (at least half) and number signs, or is a number word.

The benchmark is the query set: its windows are cut into blocks of at most `block` windows, each sent to all
tasks, and the documents are read once a block (a block of 250,000 windows takes some 25 MB).  The
documents are neither shuffled nor collected.

Every window of the benchmark is compared.  Other slot values are accepted in windows with `literals` tokens (or all
but two of a short item) that aren't placeholders; windows with fewer match verbatim, and an item that has
only such windows also with other values if all its tokens correspond and `literals` of them aren't placeholders.

Defined cases: null or empty text has no tokens and is clean; benchmark items of fewer than `width` tokens match
as a whole, those under MIN_TOKENS verbatim and only where they are a sentence or line of their own; a null
id stays null, and items with a null id count, but are named (null) only if no other item matches; repeated rows
each come out; other columns are ignored; an empty benchmark leaves all documents clean.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, NULL_ID, U, _BYTE, _cut, doc_chunks, frugal, keyed, mix, powers, text_buffer
from .substring_dedup import window_hashes
from .wordlists import GIVEN_FEMALE, GIVEN_MALE, NUMBER_WORDS, UNITS

WIDTH = 10
LITERALS = 6
MIN_TOKENS = 5
BLOCK = 250_000
NO_ITEM = np.iinfo(np.int64).max  # stands for a null item id, after all others
LITERAL, NUM, UNIT, NAME = 0, 1, 2, 3

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_NUMERIC = _DIGIT.copy()
_NUMERIC[list(b".,:/%$+-")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?:")] = True
_SLOT = mix(np.arange(1000, 1004, dtype=np.uint64))


def _segment(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, new_sentence: bool, waits: bool):
    """Tokens of a segment (start, hash, kind, begins a sentence), whether it ends one, whether marks without a word after it did."""
    seg = data[lo:hi]
    solid = ~IS_SPACE[seg]
    begin, stop = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    stop[:-1] &= ~solid[1:]
    inner = offsets[(offsets > lo) & (offsets < hi)] - lo
    begin[inner] = solid[inner]
    stop[inner - 1] = solid[inner - 1]
    s, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    last_end = int(e[-1]) if len(e) else 0
    if not len(s):
        return None, new_sentence, waits or bool((seg == 10).any())
    # sentence starts: after an end mark, a line break or a document border
    ends = _ENDS[seg[e - 1]]
    breaks = np.concatenate([[0], np.cumsum(seg == 10)])
    fresh = np.empty(len(s), bool)
    fresh[0] = new_sentence or breaks[s[0]] > 0
    fresh[1:] = ends[:-1] | (breaks[s[1:]] > breaks[e[:-1]])
    fresh[np.searchsorted(s, inner)[np.searchsorted(s, inner) < len(s)]] = True
    if lo in offsets[:-1]:
        fresh[0] = True
    # outer punctuation off: the next and the last place that isn't punctuation
    plain = np.flatnonzero(~_PUNCT[seg])
    if not len(plain):
        return None, bool(ends[-1]), waits or bool(fresh.any() or ends[-1])
    first = plain[np.minimum(np.searchsorted(plain, s), len(plain) - 1)]
    last = plain[np.maximum(np.searchsorted(plain, e) - 1, 0)] + 1
    full = (first >= s) & (first < e) & (last > first) & (last <= e)
    # a sentence begins at a token if it does so there or at one of the marks since the token before
    seen, at = np.concatenate([[0], np.cumsum(fresh)]), np.flatnonzero(full)
    begins = seen[at + 1] > np.concatenate([[0], seen[at[:-1] + 1]])
    if len(at):
        begins[0] |= waits
        waits = bool(seen[-1] > seen[at[-1] + 1])
    else:
        waits = waits or bool(fresh.any())
    waits = waits or bool(ends[-1]) or bool((seg[last_end:] == 10).any())
    s, e, fresh = first[full], last[full], fresh[full]
    n = e - s
    lower = _LOWER[seg]
    total = np.zeros(len(seg) + 1, U)
    np.cumsum(_BYTE[lower] * powers(len(seg)), out=total[1:])
    h = mix((total[e] - total[s]) * powers(len(seg) + 1, True)[s] + n.astype(U))
    count = lambda table: np.concatenate([[0], np.cumsum(table[seg])])
    digits, numeric, upper = count(_DIGIT), count(_NUMERIC), count(_UPPER)
    nd, nn, nu = digits[e] - digits[s], numeric[e] - numeric[s], upper[e] - upper[s]
    kind = np.zeros(len(s), np.int8)
    title = _UPPER[seg[s]] & (nu == 1) & (n > 1)
    kind[title & ~fresh] = NAME
    known = _known()
    kind[title & np.isin(h, known[NAME])] = NAME
    kind[np.isin(h, known[UNIT])] = UNIT
    kind[((nd > 0) & ((nn == n) | (2 * nd >= n))) | np.isin(h, known[NUM])] = NUM
    return (s + lo, h, kind, begins), bool(ends[-1]), waits


_words: dict[int, np.ndarray] = {}


def _known() -> dict[int, np.ndarray]:
    if not _words:
        for kind, words in ((NAME, GIVEN_FEMALE + GIVEN_MALE), (UNIT, UNITS), (NUM, NUMBER_WORDS)):
            raw = [w.lower().encode() for w in words]
            data = np.frombuffer(b"".join(raw), np.uint8)
            e = np.cumsum([len(w) for w in raw])
            s = np.concatenate([[0], e[:-1]])
            total = np.concatenate([np.zeros(1, U), np.cumsum(_BYTE[data] * powers(len(data)))])
            _words[kind] = np.sort(mix((total[e] - total[s]) * powers(len(data) + 1, True)[s] + (e - s).astype(U)))
    return _words


def tokens_of(data: np.ndarray, offsets: np.ndarray, segment: int = 1 << 20):
    """Tokens of documents: (value hash, kind, first token of each document with one entry more)."""
    h, kind, _, first = _tokens(data, offsets, segment)
    return h, kind, first


def _tokens(data: np.ndarray, offsets: np.ndarray, segment: int = 1 << 20):
    """As tokens_of, with a flag for tokens that begin a sentence or line."""
    parts, lo, fresh, waits = [], 0, True, True
    while lo < len(data):
        hi = _cut(data, offsets, lo, segment)
        got, fresh, waits = _segment(data, offsets, lo, hi, fresh, waits)
        if got is not None:
            parts.append(got)
        lo = hi
    if not parts:
        return np.zeros(0, U), np.zeros(0, np.int8), np.zeros(0, bool), np.zeros(len(offsets), np.int64)
    start, h, kind, begins = (np.concatenate(x) for x in zip(*parts))
    first = np.searchsorted(start, offsets)
    begins[first[:-1][first[:-1] < first[1:]]] = True
    return h, kind, begins, first


def _template(h: np.ndarray, kind: np.ndarray) -> np.ndarray:
    return np.where(kind == LITERAL, h, _SLOT[kind])


def _found(hashes: np.ndarray, got: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (window, entry) with equal hashes; hashes is sorted."""
    lo = np.searchsorted(hashes, got)
    hit = np.flatnonzero(hashes[np.minimum(lo, len(hashes) - 1)] == got)
    n = np.searchsorted(hashes, got[hit], "right") - lo[hit]
    row = np.repeat(hit, n)
    return row, lo[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


class Index:
    """Windows of a block of benchmark items, by width: templates, verbatim ones, and items to compare as a whole."""

    def __init__(self, items: list[tuple[int | None, str]], width: int, literals: int):
        self.width, self.by, self.plain, self.whole = width, {}, {}, None
        data, offsets = text_buffer(pa.array([t for _, t in items], pa.large_string()))
        h, kind, first = tokens_of(data, offsets)
        size = np.diff(first)
        ids = self.ids = np.array([NO_ITEM if i is None else i for i, _ in items], np.int64)
        literal = np.concatenate([[0], np.cumsum(kind == LITERAL)])
        for w in sorted({min(width, int(n)) for n in size if n}):
            own = size >= width if w == width else size == w
            start, item, hashes = window_hashes(_template(h, kind), first, w)
            few = literal[start + w] - literal[start]
            enough = (few >= min(literals, max(1, w - 2))) & (w >= MIN_TOKENS)
            self._add_plain(w, *(x[own[item] & ~enough] for x in (window_hashes(h, first, w)[2], item)))
            if w == width:
                loose = own & (np.bincount(item[enough], minlength=len(size)) == 0) & (literal[first[1:]] - literal[first[:-1]] >= literals)
                self._add_whole(h, kind, first, *(x[loose[item]] for x in (start, item, hashes, few)))
            keep = own[item] & enough
            start, item, hashes = start[keep], item[keep], hashes[keep]
            at = start[:, None] + np.arange(w)
            value = np.where(kind[at] == LITERAL, U(0), h[at])
            # entries of one template with equal slot values are one; the least item stands for them
            key = hashes + mix(value[:, 0])
            for k in range(1, w):
                key = mix(key + value[:, k])
            order = np.lexsort((item, ids[item], key, hashes))
            keep = np.concatenate([[True], key[order][1:] != key[order][:-1]])[: len(order)]
            order = order[keep]
            if len(order):
                self.by[w] = (hashes[order], item[order], value[order], start[order] - first[item[order]])

    def _add_plain(self, w: int, hashes: np.ndarray, item: np.ndarray) -> None:
        """Windows that only match verbatim; the least item stands for equal ones."""
        order = np.lexsort((self.ids[item], hashes))
        hashes, item = hashes[order], item[order]
        keep = np.concatenate([[True], hashes[1:] != hashes[:-1]])[: len(order)]
        if len(hashes):
            self.plain[w] = (hashes[keep], item[keep])

    def _add_whole(self, h, kind, first, start, item, hashes, few) -> None:
        """Items without a window of enough literals, found by their window with the most."""
        order = np.lexsort((start, -few, item))
        best = order[np.concatenate([[True], item[order][1:] != item[order][:-1]])[: len(order)]]
        best = best[np.argsort(hashes[best], kind="stable")]
        if len(best):
            texts = [(_template(h, kind)[a:b], np.where(kind == LITERAL, U(0), h)[a:b]) for a, b in zip(first[item[best]], first[item[best] + 1])]
            self.whole = (hashes[best], item[best], start[best] - first[item[best]], texts)

    def matches(self, h: np.ndarray, kind: np.ndarray, first: np.ndarray, begins: np.ndarray):
        """Consistent matches: (document, item id, verbatim)."""
        docs, items, same = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        t = _template(h, kind)
        for w, (hashes, item) in self.plain.items():
            start, doc, got = window_hashes(h, first, w)
            row, entry = _found(hashes, got)
            if w < MIN_TOKENS:
                end = start[row] + w
                alone = begins[start[row]] & ((end == first[doc[row] + 1]) | begins[np.minimum(end, len(h) - 1)])
                row, entry = row[alone], entry[alone]
            docs.append(doc[row])
            items.append(self.ids[item[entry]])
            same.append(np.ones(len(row), bool))
        for w, (hashes, item, value, place) in self.by.items():
            start, doc, got = window_hashes(t, first, w)
            row, entry = _found(hashes, got)
            if not len(row):
                continue
            at = start[row][:, None] + np.arange(w)
            ours = np.where(kind[at] == LITERAL, U(0), h[at])
            theirs = value[entry]
            fine = np.ones(len(row), bool)
            busy = np.flatnonzero((ours != 0).sum(1) > 1)
            a, b = ours[busy], theirs[busy]
            ok = np.ones(len(busy), bool)
            for i in range(w):
                for j in range(i + 1, w):
                    ok &= (a[:, i] == 0) | (a[:, j] == 0) | ((a[:, i] == a[:, j]) == (b[:, i] == b[:, j]))
            fine[busy] = ok
            exact = (ours == theirs).all(1)
            self._whole(doc[row], item[entry], start[row] - place[entry], ours, theirs, exact, fine)
            docs.append(doc[row][fine])
            items.append(self.ids[item[entry]][fine])
            same.append(exact[fine])
        if self.whole is not None:
            for doc, item, exact in self._whole_items(t, h, kind, first):
                docs.append(np.array([doc]))
                items.append(self.ids[[item]])
                same.append(np.array([exact]))
        return np.concatenate(docs), np.concatenate(items), np.concatenate(same)

    def _whole_items(self, t: np.ndarray, h: np.ndarray, kind: np.ndarray, first: np.ndarray):
        """(document, item, verbatim) where all tokens of an item correspond, slots one to one."""
        hashes, item, place, texts = self.whole
        start, doc, got = window_hashes(t, first, self.width)
        row, entry = _found(hashes, got)
        for e in np.unique(entry).tolist():
            template, theirs = texts[e]
            own = row[entry == e]
            at, d = start[own] - place[e], doc[own]
            inside = (at >= first[d]) & (at + len(template) <= first[d + 1])
            at, d = at[inside], d[inside]
            for k in range(len(template)):
                equal = t[at + k] == template[k]
                at, d = at[equal], d[equal]
            for a, one in zip(at.tolist(), d.tolist()):
                ours = np.where(kind[a : a + len(template)] == LITERAL, U(0), h[a : a + len(template)])
                pairs = set(zip(ours[ours != 0].tolist(), theirs[ours != 0].tolist()))
                if len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs}):
                    yield one, int(item[e]), bool((ours == theirs).all())

    @staticmethod
    def _whole(doc, item, shift, ours, theirs, exact, fine) -> None:
        """Take back re-parameterised windows whose slots don't correspond over all windows of one document, item and shift."""
        loose = np.flatnonzero(fine & ~exact)
        if not len(loose):
            return
        order = loose[np.lexsort((shift[loose], item[loose], doc[loose]))]
        new = (doc[order][1:] != doc[order][:-1]) | (item[order][1:] != item[order][:-1]) | (shift[order][1:] != shift[order][:-1])
        for own in np.split(order, np.flatnonzero(new) + 1):
            used = ours[own] != 0
            pairs = set(zip(ours[own][used].tolist(), theirs[own][used].tolist()))
            if not len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}):
                fine[own] = False

    def judge(self, data: np.ndarray, offsets: np.ndarray):
        """For each document: tokens, consistent windows, least item, whether a window is verbatim."""
        h, kind, begins, first = _tokens(data, offsets)
        doc, item, same = self.matches(h, kind, first, begins)
        n = np.bincount(doc, minlength=len(offsets) - 1)
        least = np.full(len(n), NO_ITEM)
        np.minimum.at(least, doc, item)
        verbatim = np.zeros(len(n), bool)
        verbatim[doc[same]] = True
        return np.diff(first), n, least, verbatim


def _blocks(benchmark: DataFrame, block: int, item_col: str, text_col: str):
    """The benchmark's items in lists of at most about `block` windows; each fits the driver by that bound."""
    b = benchmark.select(F.col(item_col).cast("long").alias("i"), F.coalesce(text_col, F.lit("")).alias("t"))
    words = b.agg(F.sum(F.length("t"))).first()[0] or 0  # no item has more windows than characters
    n = max(1, -(-int(words) // (4 * block)))
    for k in range(n):
        yield [(r.i, r.t) for r in b.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, literals: int = LITERALS, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, n_windows (consistent matches), item_id (least), verbatim, contaminated."""
    key_docs, found, blocks = keyed(docs, id_col, text_col), None, 0
    schema = "doc_id long, th int, n_tokens long, n_windows long, item_id long, verbatim boolean"
    for items in _blocks(benchmark, block, item_col, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(Index(items, width, literals))

        @frugal
        def run(batches, shared=shared):
            for ids, (th,), data, offsets in doc_chunks(batches, "id", "text", ("th",)):
                n_tokens, n, least, verbatim = shared.value.judge(data, offsets)
                columns = [pa.array(ids, mask=ids == NULL_ID), pa.array(th, pa.int32()), pa.array(n_tokens), pa.array(n), pa.array(least, mask=least == NO_ITEM), pa.array(verbatim)]
                yield pa.record_batch(columns, ["doc_id", "th", "n_tokens", "n_windows", "item_id", "verbatim"])

        one = key_docs.mapInArrow(run, schema)
        found, blocks = one if found is None else found.unionByName(one), blocks + 1
    if blocks > 1:  # a row for each block: add them up, equal rows stay as many as they were
        found = found.groupBy("doc_id", "th").agg(
            (F.count("*") / blocks).cast("int").alias("rows"), F.max("n_tokens").alias("n_tokens"), F.sum("n_windows").alias("n"), F.min("item_id").alias("item_id"), F.bool_or("verbatim").alias("verbatim")
        )
        found = found.withColumn("n_windows", F.floor(F.col("n") / F.col("rows"))).withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("rows"))))
        found = found.select("doc_id", "th", "n_tokens", "n_windows", "item_id", "verbatim")
    return found.drop("th").withColumn("contaminated", F.col("n_windows") > 0)


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, literals: int = LITERALS, block: int = BLOCK, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, all columns, without contaminated ones; nothing is shuffled."""
    out = docs
    at = docs.columns.index(text_col)
    for items in _blocks(benchmark, block, item_col, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(Index(items, width, literals))

        @frugal
        def run(batches, shared=shared):
            for b in batches:
                for lo in range(0, b.num_rows, 1000):
                    part = b.slice(lo, 1000)
                    _, n, _, _ = shared.value.judge(*text_buffer(part.column(at)))
                    yield part.filter(pa.array(n == 0))

        out = out.mapInArrow(run, docs.schema)
    return out


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
