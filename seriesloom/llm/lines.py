"""Fuzzy line deduplication over the whole corpus.

One scan turns every line into a hash of its normalized form and some keys from least hashes of its pairs of
neighbouring words. Equal normalized lines meet by grouping; different ones that share a key are candidates, sifted by the
Hamming distance of their SimHashes and verified by edit similarity on the lines themselves, which are fetched for candidates only. Of each
connected group of lines the first occurrence stays.

Blocks of SimHashes, the obvious way to candidates, can't give right results here. A line has few words: where one in five differs (a
similarity of 0.8) about 13 of 64 bits do, and blocks that 13 bits leave one of have 4 bits, which a sixteenth of all lines share. Within 2
bits, as blocks of 16 bits allow, hardly any similar line is found. Least hashes of word pairs find similar lines at an affordable number of keys.
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .blocking import linked
from .components import components
from .edits import near
from .words import ODD, SEED, mixed, sim_hashes, slices, words_of

SIMILARITY = 0.8
#: Keys of a line, each of the two least hashes of its word pairs. Of one word in five replaced a key is left with 0.21, so one of ten with 0.9.
BANDS = 10
#: Words of so many bytes are passed over in keys, but where a line has fewer than FEW others.
SHORT = 3
FEW = 6
#: Bits of 256 that SimHashes of similar lines may differ in: 52 on average where one word in five is replaced, with a deviation of 6.5. Lines similar
#: by characters have more words touched, so more. Unlike lines differ in 128, with a deviation of 8.
MARK_BITS = 100
_HELD = 1 << 23  # bytes of pairs that are compared by characters at once; of lines in blocks four times as many
_ROWS = 32768  # lines in blocks that are compared at once
_PAIRS = 1 << 19  # pairs whose sketches are compared at once
_FORESTS = 3  # rounds that compare only pairs which connect what no likelier pair does
_SEEN = 200_000  # hashes of lines that a task remembers, so that it gives the keys of a repeated line once


def normalized(line: bytes) -> list[bytes]:
    """Words of a line in lower case; a line is equal to another if these are."""
    return line.lower().split()


def coded(words: list[bytes]) -> str:
    """One character for each word, of a million: the edit distance of two such strings is that of the lines in words."""
    return "".join([chr(0x10000 + xxhash.xxh3_64_intdigest(w) % 0x100000) for w in words])


def hashed(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, ...]:
    """text, line number and hash of each line that has a word, of texts whose bytes lie on end; the words' hashes and bytes, and where each line's begin."""
    starts, h, size = words_of(data, begins)
    text = np.searchsorted(begins, starts, "right") - 1
    breaks = np.flatnonzero(data == 10)
    number = np.searchsorted(breaks, starts) - np.searchsorted(breaks, begins)[text]
    if not len(h):
        return text, number, h, h, size, np.zeros(0, np.int64)
    new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (number[1:] != number[:-1])])
    place = np.arange(len(h)) - np.repeat(new, np.diff(np.r_[new, len(h)]))
    keys = np.add.reduceat(mixed(h + place.astype(np.uint64) * np.uint64(ODD)), new)
    return text[new], number[new], keys, h, size, new


def _pairs(h: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of neighbouring words in order (``line``: the line of each word), the lines' ends included, and their lines."""
    new = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else np.zeros(0, np.int64)
    pair = mixed(np.insert(h, new, np.uint64(1)) * np.uint64(ODD) + np.insert(h, np.r_[new[1:], len(h)], np.uint64(2))) if len(h) else h
    return pair, np.repeat(line[new], np.diff(np.r_[new, len(h)]) + 1)


def bands(h: np.ndarray, size: np.ndarray, new: np.ndarray, chosen: np.ndarray | None = None) -> np.ndarray:
    """``BANDS`` keys (unsigned) of each line (or of the ``chosen``) from the two least hashes of its pairs of neighbouring words, its ends included.

    Words of up to ``SHORT`` bytes are passed over: they are the frequent ones, whose pairs would bring unlike lines together. A line of fewer than ``FEW`` others also has the pairs of all its words.
    """
    sizes = np.diff(np.r_[new, len(h)])
    if chosen is not None:
        on = np.repeat(chosen, sizes)
        h, size, sizes = h[on], size[on], sizes[chosen]
    out = np.empty((len(sizes), BANDS), np.uint64)
    if not len(sizes):
        return out
    line = np.repeat(np.arange(len(sizes)), sizes)
    rare = size > SHORT
    few = (np.bincount(line[rare], minlength=len(sizes)) < FEW)[line]
    pair, line = map(np.concatenate, zip(_pairs(h[rare], line[rare]), _pairs(h[few], line[few])))
    by = np.argsort(line, kind="stable")
    pair, line = pair[by], line[by]
    at = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    for band, (salt, odd) in enumerate(np.random.default_rng(SEED).integers(0, 1 << 63, (BANDS, 2)).astype(np.uint64)):
        x = (pair ^ salt) * (odd | np.uint64(1))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(ODD)
        least = np.minimum.reduceat(x, at)
        x[x == least[line]] = ~np.uint64(0)  # a pair that is there twice is one
        out[:, band] = mixed(mixed(least + np.uint64(band)) * np.uint64(ODD) + np.minimum.reduceat(x, at))
    return out


def keyed_docs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """did, th (they stand for a row: repeated rows have the same) and text."""
    i, t = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return docs.select(common.id_key(i).alias("did"), common.text_key(i, t).alias("th"), t.alias("text"))


def line_table(docs: DataFrame) -> DataFrame:
    """did, th, line_no, h and keys for each line with a word. ``docs``: did, th, text. A task gives the keys of a repeated line once, else none."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for at, _, data, begins in slices(batch.column("text")):
                text, number, h, words, size, new = hashed(data, begins)
                fresh = np.zeros(len(new), bool)
                fresh[np.unique(h, return_index=True)[1]] = True
                fresh[[i for i, x in zip(np.flatnonzero(fresh).tolist(), h[fresh].tolist()) if x in seen]] = False
                if len(seen) > _SEEN:
                    seen.clear()
                seen.update(h[fresh].tolist())
                ids = batch.select(["did", "th"]).take(pa.array(text + at, pa.int64()))
                ends = np.r_[0, np.cumsum(fresh)].astype(np.int32) * BANDS
                found = pa.ListArray.from_arrays(pa.array(ends), pa.array(bands(words, size, new, fresh).view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([*ids.columns, pa.array(number.astype(np.int32)), pa.array(h.view(np.int64)), found], ["did", "th", "line_no", "h", "keys"])

    return docs.mapInArrow(run, "did long, th long, line_no int, h long, keys array<long>")


_LINE = "h long, code string, line string, n int, c int, w0 long, w1 long, w2 long, w3 long"


def fetch_lines(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of ``wanted`` (did, th, line_no, h): h, code, the normalized line, numbers of words and characters, 256 bits of SimHash."""
    by = wanted.groupBy("did", "th").agg(F.collect_list(F.struct("line_no", "h")).alias("want"))  # lines of one document
    found = docs.join(by.hint("shuffle_hash"), ["did", "th"])  # the lesser side, in parts
    one = F.explode(F.transform("want", lambda w: F.struct(w["h"].alias("h"), F.get(F.split("text", "\n", -1), w["line_no"]).alias("line"))))
    each = found.select(one.alias("x")).groupBy("x.h").agg(F.min("x.line").alias("line"))  # of repeated rows

    def run(batches):
        for batch in batches:
            for a, b, data, begins in slices(batch.column("line")):
                starts, words, _ = words_of(data, begins)  # each line has one at least
                first = np.searchsorted(starts, begins)
                code, line, chars = [], [], []
                for x in common.binary_values(batch.column("line").slice(a, b - a)):
                    parts = normalized(x)
                    plain = b" ".join(parts).decode()
                    code.append(coded(parts))
                    chars.append(len(plain))
                    line.append(plain)
                marks = sim_hashes(words, first, 4).view(np.int64)
                cols = [pa.array(code, pa.string()), pa.array(line, pa.string()), pa.array(np.diff(np.r_[first, len(words)]).astype(np.int32)), pa.array(chars, pa.int32()), *(pa.array(marks[:, i]) for i in range(4))]
                yield pa.RecordBatch.from_arrays([batch.column("h").slice(a, b - a), *cols], ["h", "code", "line", "n", "c", "w0", "w1", "w2", "w3"])

    return each.mapInArrow(run, _LINE)


def _similar_characters(batches):
    """u and v of the pairs that are similar by words, or else of whose lines (``a``, ``b``, null if known to differ by more) ``most`` edits make one of the other."""
    held, size = [], 0

    def links(table: pa.Table):
        yes = table.column("by_words").to_numpy(zero_copy_only=False).astype(bool)
        on = np.flatnonzero(table.column("a").is_valid().to_numpy(zero_copy_only=False))
        rest = table.take(pa.array(on))
        yes[on] = near(rest.column("a").to_pylist(), rest.column("b").to_pylist(), rest.column("most").to_numpy())
        return table.select(["u", "v"]).filter(pa.array(yes)).to_batches()

    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= _HELD:
            yield from links(pa.Table.from_batches(held))
            held, size = [], 0
    if held:
        yield from links(pa.Table.from_batches(held))


def _words(lines: pa.ChunkedArray, rows: np.ndarray) -> dict[int, np.ndarray]:
    """32 bits of a hash of each word of these normalized lines, by row."""
    out, at = {}, 0
    for part in lines.take(pa.array(rows)).chunks:
        for a, b, data, begins in slices(part):
            starts, h, _ = words_of(data, begins)
            out.update(zip(rows[at + a : at + b].tolist(), np.split(h.astype(np.uint32), np.searchsorted(starts, begins[1:]))))
        at += len(part)
    return out


def _forest(a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Which pairs connect what no earlier pair does."""
    up, out = {}, []
    for i, (x, y) in enumerate(zip(a.tolist(), z.tolist())):
        while (w := up.get(x, x)) != x:
            up[x] = x = up.get(w, w)
        while (w := up.get(y, y)) != y:
            up[y] = y = up.get(w, w)
        if x != y:
            up[x] = y
            out.append(i)
    return np.array(out, np.int64)


def _connecting(rows: pa.Table, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """u and v of links between similar lines, of whole pairs of blocks (see ``blocking.dealt``): as many as connect all that are found."""
    k, i, j, b, u, c, n, size = (rows.column(x).to_numpy() for x in ("k", "i", "j", "b", "u", "c", "words", "chars"))
    w = np.stack([rows.column(x).to_numpy().view(np.uint64) for x in ("w0", "w1", "w2", "w3")], axis=1)
    line, lower = rows.column("line"), [frozenset(x) for x in rows.column("lower").to_pylist()]
    # Of a block with itself, a row meets those after it; of two blocks, one of the first meets all of the second.
    at = np.arange(len(u))
    new = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
    group = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(u)]))
    end = np.r_[new[1:], len(u)]
    begin = np.where(i == j, at + 1, (new + np.bincount(group, b == i, len(new)).astype(np.int64))[group])
    count = np.where((i == j) | (b == i), end[group] - begin, 0)
    total = np.r_[0, np.cumsum(count)]
    kinds, root = np.unique(c, return_inverse=True)
    root, up = root.astype(np.int64), list(range(len(kinds)))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    limit = lambda x, a, b: np.floor(np.maximum(x[a], x[b]) * (1 - similarity) + 1e-9).astype(np.int64)
    out, start = [], 0
    while start < len(u):
        stop = max(int(np.searchsorted(total, total[start] + _PAIRS, "right")) - 1, start + 1)
        many = count[start:stop]
        a = np.repeat(at[start:stop], many)
        z = np.arange(len(a)) + np.repeat(begin[start:stop] - (total[start:stop] - total[start]), many)
        start = stop
        on = np.flatnonzero(root[a] != root[z])
        a, z = a[on], z[on]
        apart = sum(np.bitwise_count(w[a, x] ^ w[z, x]).astype(np.int64) for x in range(4))
        by_words, by_chars = (np.abs(x[a] - x[z]) <= limit(x, a, z) for x in (n, size))
        on = np.flatnonzero((apart <= MARK_BITS) & (by_words | by_chars))
        on = on[np.argsort(apart[on], kind="stable")]  # the likeliest first: what they connect needs no other pair
        a, z = a[on], z[on]
        first = np.array([lower[r].isdisjoint(lower[s]) for r, s in zip(a.tolist(), z.tolist())], bool)
        a, z, on = a[first], z[first], on[first]
        # Words first, which are fewer; characters only of what they leave unconnected.
        for x, asked in ((n, by_words[on]), (size, by_chars[on])):
            still = np.flatnonzero(asked & (root[a] != root[z]))
            p, q = a[still], z[still]
            held = np.unique([p, q])
            texts = _words(line, held) if x is n else {}
            step = 0
            while len(p):
                # Similar words are the rule: first what connects most with fewest pairs, then all pairs, so that unlike lines don't take a round for each.
                tried = _forest(root[p], root[q]) if x is n and step < _FORESTS else np.arange(min(len(p), 1 << 14))
                r, s, step = p[tried], q[tried], step + 1
                if x is size:
                    need = np.array([y for y in np.unique([r, s]).tolist() if y not in texts], np.int64)
                    texts.update(zip(need.tolist(), (np.frombuffer(y.encode("utf-32-le"), np.uint32) for y in line.take(pa.array(need)).to_pylist())))
                yes = near([texts[y] for y in r.tolist()], [texts[y] for y in s.tolist()], limit(x, r, s))
                for r, s in zip(r[yes].tolist(), s[yes].tolist()):
                    y, v = find(int(root[r])), find(int(root[s]))
                    if y != v:
                        up[y] = v
                        out.append((u[r], u[s]))
                top = np.array(up)
                while (top[top] != top).any():
                    top = top[top]
                root, up = top[root], list(range(len(up)))
                left = root[p] != root[q]
                left[tried] = False
                p, q = p[left], q[left]
    return tuple(np.array(out, np.int64).reshape(-1, 2).T)


def compared(rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links (u, v) that connect similar lines within each pair of blocks (``rows``: see ``blocking.dealt``, and mark). A task compares some whole pairs of blocks at a time."""

    def links(held: list[pa.RecordBatch]):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _connecting(pa.Table.from_batches(held), similarity)], ["u", "v"])

    def run(batches):
        held, rows, size = [], 0, 0
        for batch in batches:
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows >= _ROWS or size >= 4 * _HELD:
                table = pa.Table.from_batches(held)
                k, i, j = (table.column(x).to_numpy() for x in "kij")
                whole = np.flatnonzero((k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
                if len(whole):
                    cut = int(whole[-1]) + 1
                    yield links(table.slice(0, cut).to_batches())
                    held = table.slice(cut).to_batches()
                    rows, size = len(table) - cut, sum(x.nbytes for x in held)
        if held:
            yield links(held)

    mark = (F.col("mark")[x].alias({"n": "words", "c": "chars"}.get(x, x)) for x in ("n", "c", "w0", "w1", "w2", "w3", "line"))
    rows = rows.select("k", "i", "j", "b", "u", "c", "lower", *mark).repartition("k", "i", "j").sortWithinPartitions("k", "i", "j", "b")
    return rows.mapInArrow(run, "u long, v long")


def similar_lines(docs: DataFrame, lines: DataFrame, kinds: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links (u, v) between similar lines that connect all similar pairs with a common key, however many lines share it."""
    fetched = []
    limit = lambda a, b: F.floor(F.greatest(a, b) * (1 - similarity) + 1e-9).cast("int")

    def prepare(nodes: DataFrame):
        wanted = common.materialize(kinds.join(nodes.withColumnRenamed("u", "h"), "h").select("first.*", "h"), "line-wanted")
        text = common.materialize(fetch_lines(docs, wanted), "line-texts")
        common.drop(wanted)
        fetched.append(text)
        return text.select(F.col("h").alias("u"), F.struct("n", "c", "w0", "w1", "w2", "w3", "code", "line").alias("mark"))

    sized = lambda a, b, x: F.abs(a[x] - b[x]) <= limit(a[x], b[x])

    def alike(a, b):
        """Sizes and sketches rule out most pairs before their words, and where these are not similar their characters, are compared."""
        apart = reduce(Column.__add__, (F.bit_count(a[x].bitwiseXOR(b[x])) for x in ("w0", "w1", "w2", "w3")))
        return (apart <= MARK_BITS) & (sized(a, b, "n") | sized(a, b, "c"))

    def verified(pairs: DataFrame) -> DataFrame:
        a, b = F.col("mu"), F.col("mv")
        words = sized(a, b, "n") & (F.call_function("levenshtein", a["code"], b["code"], limit(a["n"], b["n"])) >= 0)
        rows = pairs.select("u", "v", words.alias("by_words"), sized(a, b, "c").alias("sized"), limit(a["c"], b["c"]).alias("most"), a["line"].alias("a"), b["line"].alias("b"))
        texts = (F.when(F.col("sized") & ~F.col("by_words"), F.col(x)).alias(x) for x in ("a", "b"))
        return rows.select("u", "v", "by_words", "most", *texts).mapInArrow(_similar_characters, "u long, v long")

    out = linked(lines.select(F.explode("keys").alias("k"), F.col("h").alias("u")), prepare, alike, verified, partial(compared, similarity=similarity))
    common.drop(*fetched)
    return out


def groups(docs: DataFrame, lines: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """h and the first occurrence (did, th, line_no) of the group of each line that is not alone."""
    first = F.min(F.struct("did", "th", "line_no")).alias("first")
    kinds = common.materialize(lines.groupBy("h").agg(first, F.count("*").alias("n")), "line-kinds")
    links = similar_lines(docs, lines, kinds, similarity)
    comp = components(links)
    known = kinds.join(comp.select(F.col("node").alias("h"), "component"), "h", "left").where("n > 1 or component is not null").withColumn("component", F.coalesce("component", "h"))
    best = known.groupBy("component").agg(F.min("first").alias("first"))
    out = common.materialize(known.select("h", "component").join(best, "component").select("h", "first"), "line-groups")
    common.drop(kinds, links, comp)
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """All columns of ``docs`` with repeated lines cut from the text, and __n_lines, __n_dropped.

    Lines are equal if their words are (ASCII case and white space aside). They are linked if they share one of
    ``BANDS`` keys and their edit similarity (1 - edits / the longer one's length) is ``similarity`` or more, in words or in
    characters, whatever their length. The first line of each connected group stays, by id, then hash of the text, then
    line number. Lines without words always stay. A null text stays null, null ids come first. Rows that repeat both id and text count as one
    occurrence and keep the same lines. Documents without lines left have an empty text; no document goes. Very long lines are compared
    whole. An empty table gives an empty result; other columns, whatever their names, pass through.
    """
    keyed = keyed_docs(docs, id_col, text_col)
    lines = common.materialize(line_table(keyed), "lines")
    group = groups(keyed, lines, similarity)
    gone = lines.select("did", "th", "line_no", "h").join(group, "h").where(F.struct("did", "th", "line_no") != F.col("first"))
    gone = gone.groupBy(F.col("did").alias("__d"), F.col("th").alias("__t")).agg(F.sort_array(F.collect_set("line_no")).alias("__gone"))  # lines of one document
    gone = common.materialize(gone, "lines-gone")
    common.drop(lines, group)
    i, t = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    cols = [F.col(f"`{c}`").alias(f"__c{k}") for k, c in enumerate(docs.columns)]
    rows = docs.select(*cols, common.id_key(i).alias("__d"), common.text_key(i, t).alias("__t")).join(gone.hint("shuffle_hash"), ["__d", "__t"], "left")
    at = docs.columns.index(text_col)
    rows = rows.select(*(f"__c{k}" for k in range(len(cols))), "__gone")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__gone") + ", __n_lines int, __n_dropped int"

    def run(batches):
        for batch in batches:
            text, many, dropped = [], [], []
            gone = batch.column("__gone").to_pylist()
            for data, out in zip(common.binary_values(batch.column(at)), gone):
                many.append(0 if data is None else data.count(b"\n") + 1)
                if out:
                    drop = set(out)
                    data = b"\n".join([x for k, x in enumerate(data.split(b"\n")) if k not in drop])
                text.append(data)
                dropped.append(len(out or ()))
            arrays = [pa.array(text, pa.binary()).cast(batch.schema.field(at).type) if k == at else batch.column(k) for k in range(batch.num_columns) if batch.schema.names[k] != "__gone"]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(many, pa.int32()), pa.array(dropped, pa.int32())], [*(n for n in batch.schema.names if n != "__gone"), "__n_lines", "__n_dropped"])

    out = rows.mapInArrow(run, schema)
    return out.select(*(F.col(f"__c{k}").alias(c) for k, c in enumerate(docs.columns)), "__n_lines", "__n_dropped")


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"))
