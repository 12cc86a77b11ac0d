"""Repeated passages by the interval tree of an enhanced suffix array, built where repeats can be and nowhere else.

Two starts of the same `length` bytes are found in three steps.

1. **Stretches.** Each start takes as its anchor the smallest hashed `GRAM`-byte string of its `length` bytes (the first
   of equal ones), so equal strings have equal anchors at the same place. Neighbouring starts with one anchor make a
   stretch: the bytes from its first start to the end of its last string, at most two lengths. Starts whose anchor gram
   occurs once in the corpus cannot repeat and go. Stretches of equal bytes are a class, kept once with its number of
   occurrences; a class that is the only one of its gram is a repeat as it stands.
2. **Suffix arrays.** All classes of a gram meet in one task (equal strings share a gram, so none is missed). Their suffixes
   of `length` bytes or more are sorted, neighbours give the common prefixes, and a stack scan walks the interval tree:
   an interval whose occurrences differ in the byte before (or begin a stretch) is a maximal repeat and gets every
   occurrence below it that no deeper maximal repeat has taken; `parent` leads to the enclosing one. So a group's
   occurrences are its own and those of its descendants, and rows stay linear in the suffixes.
3. **Crowded grams** (more than CROWD classes, such as a line in a third of all documents) never meet in one task: their
   stretches are cut into short runs of starts, keyed by the bytes all strings of the run share, then into single
   strings, and only keys that occur twice go on. That is exact too, and each step is an aggregation with partial sums.

A repeat longer than a stretch comes as a chain of groups, one per stretch; their union covers it. Classes and grams
are told apart by 64-bit hashes of their own each (128 together).

With `words` the same steps run over words (`[^\\x20\\x09-\\x0D]+`) in place of bytes: a text is the sequence of the 64-bit hashes of
its words, and all lengths and places are words. So a passage is found by its number of words, however short they are.

Defined cases: NULL and empty texts, and texts shorter than `length`, have no repeats. Very long texts are cut into runs
of SEGMENT starts, with the bytes that the last string needs. Repeated rows are documents of their own, so each
repeats the other; NULL keys are kept. Ties between hashes go to the first place. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.session import materialise

LENGTH = 400
GRAM = 128
#: The same in words: passages of over 50.
WORDS, WORD_GRAM = 51, 8
#: Bytes of a word's hash.
CODE = 8
CROWD = 512
#: Starts worked on at once; places inside a segment take the low PLACE_BITS bits.
SEGMENT, PLACE_BITS = 1 << 19, 20
#: Bytes of stretches that one suffix array holds, a gram always whole.
ARRAY_BYTES = 1 << 18
#: Starts in a run of a crowded gram.
RUN = 16

_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_BASE = 0x9E3779B97F4A7C15
_DIVERSE = -1


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _mixed(hashed: np.ndarray) -> np.ndarray:
    hashed ^= hashed >> np.uint64(31)
    hashed *= np.uint64(0xD6E8FEB86659FD93)
    hashed ^= hashed >> np.uint64(32)
    return hashed


class Words:
    """Hash of every word of the texts between offsets, and the offsets counted in words."""

    def __init__(self):
        self.table = np.random.default_rng(51).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.up, self.down = self._both(2 * SEGMENT)

    def _both(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        return _powers(_BASE, count), _powers(pow(_BASE, -1, 1 << 64), count)

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = int(offsets[0])
        data, offsets = data[first : int(offsets[-1])], offsets - first
        up, down = (self.up, self.down) if len(data) < len(self.up) else self._both(len(data) + 1)
        blank = _BLANK[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True  # texts adjoin, and no word crosses from one to the next
        starts = np.flatnonzero(~blank & (cut[:-1] | np.concatenate([[True], blank[:-1]])))
        ends = np.flatnonzero(~blank & (cut[1:] | np.concatenate([blank[1:], [True]]))) + 1
        sums = np.concatenate([[np.uint64(0)], np.cumsum(self.table[data] * up[: len(data)], dtype=np.uint64)])
        hashed = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)
        return _mixed(hashed), np.searchsorted(starts, offsets)

    def groups(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of the first text, hashes, offsets) for texts of about SEGMENT bytes at a time, a text always whole."""
        at = 0
        while at < len(offsets) - 1:
            upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SEGMENT, side="right")) - 1)
            yield at, *self.of(data, offsets[at : upto + 1])
            at = upto


class Anchors:
    """Anchor of every string of `length` bytes, or words."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram, self.span = length, gram, length - gram + 1
        count = SEGMENT + length
        self.up, self.down = _powers(_BASE, count), _powers(pow(_BASE, -1, 1 << 64), count)
        self.table = np.random.default_rng(400).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def of(self, data: np.ndarray) -> np.ndarray:
        """Place of the anchor of the string at each start of `data`."""
        m = len(data)
        values = self.table[data] if data.dtype == np.uint8 else data
        sums = np.concatenate([[np.uint64(0)], np.cumsum(values * self.up[:m], dtype=np.uint64)])
        hashed = _mixed((sums[self.gram :] - sums[: -self.gram]) * self.down[: m - self.gram + 1])
        low = np.uint64((1 << PLACE_BITS) - 1)
        least, width = (hashed & ~low) | np.arange(len(hashed), dtype=np.uint64), 1
        while 2 * width <= self.span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < self.span:
            least = np.minimum(least[: m - self.length + 1], least[self.span - width :])
        return (least & low).astype(np.int64)

    def stretches(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(first start, last start, anchor) of the stretches of the texts between `offsets`, ascending."""
        for at in range(int(offsets[0]), int(offsets[-1]) - self.length + 1, SEGMENT):
            last = min(at + SEGMENT, int(offsets[-1]) - self.length + 1)
            anchor = self.of(data[at : last + self.length - 1]) + at
            places = np.arange(at, last)
            ends = np.repeat(offsets[1:], np.diff(np.clip(offsets, at, last)))
            inside = np.flatnonzero(places + self.length <= ends)
            if not len(inside):
                continue
            places, anchor = places[inside], anchor[inside]
            cut = np.flatnonzero((np.diff(places) != 1) | (np.diff(anchor) != 0)) + 1
            yield places[np.concatenate([[0], cut])], places[np.concatenate([cut, [len(places)]]) - 1], anchor[np.concatenate([[0], cut])]


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a column of texts, and where each text begins in them."""
    texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8), offsets


def _coded(rows: DataFrame) -> DataFrame:
    """(text, ...) with the hashes of the text's words, as bytes, in its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Words()
        for batch in batches:
            for first, codes, places in reader.groups(*_bytes_of(batch.column(0))):
                cells = [codes[a:b].tobytes() for a, b in zip(places.tolist(), places[1:].tolist())]
                rest = batch.slice(first, len(cells)).columns[1:]
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.binary()), *rest], names=["bytes", *batch.schema.names[1:]])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"bytes binary, {kinds}")


def stretches(docs: DataFrame, length: int, gram: int, bodies: bool, words: bool = False) -> DataFrame:
    """Stretches of (doc, mark, text): gram, and with `bodies` doc, mark, first start, starts after it, anchor's place, hash of the bytes."""
    unit = CODE if words else 1
    names = ["gram"] + (["body", "doc", "mark", "at", "more", "back"] if bodies else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, reader = Anchors(length, gram), Words() if words else None
        for batch in batches:
            data, offsets = _bytes_of(batch.column(2))
            if offsets[-1] - offsets[0] < length:
                continue
            for first, units, places in reader.groups(data, offsets) if words else [(0, data, offsets)]:
                if places[-1] - places[0] < length:
                    continue
                raw = memoryview(units).cast("B")
                for low, high, anchor in finder.stretches(units, places):
                    grams = (xxhash.xxh64_intdigest(raw[a : a + gram * unit], 1) for a in (anchor * unit).tolist())
                    columns = [pa.array(np.fromiter(grams, np.uint64, len(anchor)).view(np.int64))]
                    if bodies:
                        whole = (xxhash.xxh3_64_intdigest(raw[a:b], 2) for a, b in zip((low * unit).tolist(), ((high + length) * unit).tolist()))
                        owner = np.searchsorted(places, low, side="right") - 1
                        rows = pa.array(first + owner)
                        columns += [
                            pa.array(np.fromiter(whole, np.uint64, len(low)).view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows),
                            pa.array((low - places[owner]).astype(np.int32)), pa.array((high - low).astype(np.int32)), pa.array((anchor - low).astype(np.int32)),
                        ]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = {"gram": "bigint", "body": "bigint", "doc": "bigint", "mark": "int", "at": "int", "more": "int", "back": "int"}
    return docs.select("doc", "mark", "text").mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in names))


def maximal_repeats(pieces: list[bytes], weights: list[int], length: int, unit: int = 1) -> list[tuple[int, int, int, int, int, int]]:
    """Maximal repeats of `length` units of `unit` bytes or more among the pieces, a piece standing for `weight` occurrences of itself.

    Rows (piece, start, size, group, parent, occurrences): every occurrence under the deepest group that has it; a group
    whose occurrences are all in deeper ones has a row with its first in the order of the suffixes.
    """
    counts = np.array([len(p) // unit - length + 1 for p in pieces])
    owner, shift = np.repeat(np.arange(len(pieces)), counts), np.concatenate([np.arange(c) for c in counts])
    suffixes = [p[s * unit :] for p, c in zip(pieces, counts) for s in range(c)]
    order = np.array(sorted(range(len(suffixes)), key=suffixes.__getitem__))
    del suffixes
    owner, shift = owner[order], shift[order]
    sizes = np.array([len(p) // unit for p in pieces])
    rest, widest = (sizes[owner] - shift), int(sizes.max())
    joined = np.frombuffer(b"".join(pieces) + bytes(widest * unit), f"u{unit}")
    window = np.lib.stride_tricks.sliding_window_view(joined, widest)
    places = (np.cumsum(sizes) - sizes)[owner] + shift
    common = np.zeros(len(order), np.int64)  # with the next suffix
    for at in range(0, len(order) - 1, 4096):
        rows = window[places[at : at + 4097]]
        differ = rows[1:] != rows[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), widest)
        common[at : at + len(first)] = np.minimum(first, np.minimum(rest[at : at + len(first)], rest[at + 1 : at + 1 + len(first)]))
    common[common < length] = 0

    rows: list[list[int]] = []
    parents: dict[int, int] = {}
    stack: list[list] = []  # [size, unit before, suffixes not yet in a group, groups below, occurrences, first suffix]

    def close(size: int, node: list) -> None:
        group = len(parents)
        parents[group] = -1
        for below in node[3]:
            parents[below] = group
        rows.extend([int(owner[k]), int(shift[k]), size, group, node[4]] for k in node[2] or [node[5]])
        node[2], node[3] = [], [group]

    open_ = (common > 0) | (np.concatenate([[0], common[:-1]]) > 0) | (np.array(weights)[owner] > 1)
    for k in np.flatnonzero(open_).tolist():
        piece, start, ahead = pieces[owner[k]], int(shift[k]), int(common[k])
        node = [0, piece[(start - 1) * unit : start * unit] if start else _DIVERSE, [k], [], weights[owner[k]], k]
        if node[4] > 1 and not start and rest[k] > max(ahead, common[k - 1] if k else 0):
            close(int(rest[k]), node)
        while stack and stack[-1][0] >= max(ahead, 1):
            top = stack[-1]
            top[1] = top[1] if top[1] == node[1] else _DIVERSE
            top[2] += node[2]
            top[3] += node[3]
            top[4] += node[4]
            node = top
            if top[0] == ahead:
                break
            stack.pop()
            if top[1] == _DIVERSE:
                close(top[0], top)
        if ahead and not (stack and stack[-1] is node):
            stack.append([ahead, *node[1:]])
    return [(p, s, size, group, parents[group], n) for p, s, size, group, n in rows]


_FOUND = "gram bigint, body bigint, start int, size int, `group` bigint, parent bigint, occurrences bigint"


def _arrays(pieces: DataFrame, length: int, unit: int) -> DataFrame:
    """Maximal repeats of (gram, body, n, data) rows, all rows of a gram in one suffix array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows):
            out = maximal_repeats([r[3] for r in rows], [r[2] for r in rows], length, unit)
            columns = [[rows[p][0] for p, *_ in out], [rows[p][1] for p, *_ in out], *([r[k] for r in out] for k in range(1, 6))]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], names=["gram", "body", "start", "size", "group", "parent", "occurrences"]
            )

        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= ARRAY_BYTES and row[0] != held[-1][0]:
                    yield done(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield done(held)

    rows = pieces.select("gram", "body", "n", "data").repartition("gram").sortWithinPartitions("gram", "body")
    return rows.mapInArrow(run, _FOUND)


def _crowded(pieces: DataFrame, length: int, unit: int) -> DataFrame:
    """Repeated strings of (gram, body, n, more, back, data) rows by counts alone, each string a group of its own.

    Run j has the starts from RUN * j to RUN * j + RUN - 1 bytes before the anchor, as far as the stretch has them. Of words, a
    run that repeats as a whole is one group, and only the strings of other runs have groups of their own.
    """
    run = F.explode(F.sequence(F.floor((F.col("back") - F.col("more")) / RUN).cast("int"), F.floor(F.col("back") / RUN).cast("int")))
    runs = pieces.select("gram", "body", "n", "more", "back", "data", run.alias("run"))
    runs = runs.withColumn("from", F.col("back") - F.col("run") * RUN)  # the last start of a whole run
    runs = runs.withColumn("start", F.greatest(F.lit(0), F.col("from") - RUN + 1)).withColumn("starts", F.least("more", "from") - F.col("start") + 1)
    runs = runs.withColumn("shared", F.xxhash64(F.expr(f"substring(data, {unit} * from + 1, {unit * (length + 1 - RUN)})"), "gram", "run"))
    runs = materialise(runs.selectExpr("gram", "body", "n", "start", "starts", "shared", f"substring(data, {unit} * start + 1, {unit} * ({length - 1} + starts)) AS data"), "runs")
    twice = runs.groupBy("shared").agg(F.sum("n").alias("_n")).where("_n > 1").select("shared")
    kept = runs.join(materialise(twice, "twice"), "shared", "left_semi")
    wholes = None
    if unit > 1:
        kept = kept.withColumn("w1", F.xxhash64("data", F.lit(1))).withColumn("w2", F.xxhash64("data", F.lit(2)))
        whole = kept.groupBy("w1", "w2").agg(F.sum("n").alias("occurrences")).where("occurrences > 1")
        kept = materialise(kept.join(materialise(whole, "whole"), ["w1", "w2"], "left"), "kept")
        wholes = kept.where("occurrences IS NOT NULL").selectExpr(
            "gram", "body", "start", f"cast({length - 1} + starts AS int) AS size", "w1 AS `group`", "cast(-1 AS bigint) AS parent", "occurrences"
        )
    place = F.explode(F.sequence(F.lit(0), F.col("starts") - 1))
    single = kept.select("gram", "body", "n", "start", "data", place.alias("_k"), (F.col("occurrences").isNull() if wholes is not None else F.lit(True)).alias("open"))
    string = F.expr(f"substring(data, {unit} * _k + 1, {unit * length})")
    single = single.select(
        "gram", "body", "n", "open", (F.col("start") + F.col("_k")).alias("start"), F.xxhash64(string, F.lit(1)).alias("h1"), F.xxhash64(string, F.lit(2)).alias("h2")
    )
    single = materialise(single, "strings")
    totals = single.groupBy("h1", "h2").agg(F.sum("n").alias("occurrences")).where("occurrences > 1")
    found = single.where("open").join(materialise(totals, "totals"), ["h1", "h2"]).select(
        "gram", "body", F.col("start").cast("int").alias("start"), F.lit(length).alias("size"), F.col("h1").alias("group"), F.lit(-1).cast("long").alias("parent"), "occurrences"
    )
    return found if wholes is None else found.unionByName(wholes)


class Repeats:
    """Repeats of a table: `places` has a row per stretch that may repeat, `found` the repeats of each class of stretches.

    With `words`, `length` and `gram` count words.
    """

    def __init__(
        self, docs: DataFrame, key: str = "doc_id", text: str = "text", length: int | None = None, gram: int | None = None, crowd: int = CROWD, words: bool = False
    ):
        length, gram, unit = length or (WORDS if words else LENGTH), gram or (WORD_GRAM if words else GRAM), CODE if words else 1
        self.docs = docs.select(F.col(key).cast("long").alias("doc"), F.hash(text).alias("mark"), F.col(text).alias("text"))
        self.key, self.length = key, length
        counts = stretches(self.docs, length, gram, False, words).groupBy("gram").count().where("count > 1").select("gram")
        # Counts are written before they are joined: a join straight on an aggregate cannot split a hot key.
        counts = materialise(counts, "grams")
        self.places = materialise(stretches(self.docs, length, gram, True, words).join(counts, "gram", "left_semi"), "places")
        classes = self.places.groupBy("gram", "body").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "mark", "at", "more", "back")).alias("first"))
        classes = materialise(classes, "classes")
        kinds = materialise(classes.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")), "kinds")
        classes = classes.join(kinds, "gram")
        alone = classes.where("kinds = 1 AND n > 1").select(
            "gram", "body", F.lit(0).alias("start"), (F.col("first.more") + length).alias("size"), F.lit(0).cast("long").alias("group"), F.lit(-1).cast("long").alias("parent"),
            F.col("n").alias("occurrences"),
        )
        wanted = classes.where("kinds > 1").select("first.*", "gram", "body", "n", (F.col("kinds") > crowd).alias("crowded"))
        listed = wanted.groupBy("doc", "mark").agg(F.collect_list(F.struct("at", "more", "back", "gram", "body", "n", "crowded")).alias("wanted"))
        same = [self.docs["doc"].eqNullSafe(listed["doc"]), self.docs["mark"] == listed["mark"]]
        # Equal rows hold the same texts: one of them is enough, so a group by the key comes first.
        held = self.docs.join(listed, same).select("text", "wanted", listed["doc"], listed["mark"])
        held = _coded(held) if words else held.withColumn("bytes", F.encode("text", "utf-8"))
        cut = F.transform("wanted", lambda w: w.withField("data", F.col("bytes").substr(w["at"] * unit + 1, (w["more"] + length) * unit)))
        pieces = materialise(held.select(F.inline(cut)).dropDuplicates(["gram", "body"]), "pieces")
        self.found = materialise(alone.unionByName(_arrays(pieces.where("NOT crowded"), length, unit)).unionByName(_crowded(pieces.where("crowded"), length, unit)), "found")

    def occurrences(self) -> DataFrame:
        """(group, parent, size, occurrences, key, start): each place under the deepest maximal repeat that has it."""
        named = self.found.withColumn("parent", F.when(F.col("parent") >= 0, F.concat_ws("-", F.hex("gram"), "parent")))
        named = named.withColumn("group", F.concat_ws("-", F.hex("gram"), "group"))
        return self.places.join(named, ["gram", "body"]).select(
            "group", "parent", "size", "occurrences", F.col("doc").alias(self.key), (F.col("at") + F.col("start")).alias("start")
        )

    def _spans(self) -> DataFrame:
        """(doc, mark, spans): lists of the repeats of a document, a list per stretch."""
        spans = materialise(self.found.groupBy("gram", "body").agg(F.collect_set(F.struct("start", "size")).alias("spans")), "spans")
        moved = F.transform("spans", lambda s: F.struct((F.col("at") + s["start"]).alias("start"), s["size"].alias("size")))
        return self.places.join(spans, ["gram", "body"]).select("doc", "mark", moved.alias("spans"))

    def removed(self, passages: Repeats | None = None) -> DataFrame:
        """(key, n_bytes, n_removed, n_spans, kept_sha256) of every document without its repeated bytes.

        With `passages`, the repeats of the same table in words, also n_passage_words: words in a passage that stands elsewhere too.
        """
        lists = self._spans().withColumn("passages", F.lit(None).cast("array<struct<start: int, size: int>>"))
        if passages is not None:
            lists = lists.unionByName(passages._spans().withColumnRenamed("spans", "passages"), allowMissingColumns=True)
        per = lists.groupBy("doc", "mark").agg(*(F.flatten(F.collect_list(k)).alias(k) for k in ("spans", "passages")))
        same = [self.docs["doc"].eqNullSafe(per["doc"]), self.docs["mark"] == per["mark"]]
        parts = [per[k][part].alias(f"{k}_{part}") for k in ("spans", "passages") for part in ("start", "size")]
        rows = self.docs.join(per, same, "left").select(self.docs["doc"], "text", *parts)
        names = [self.key, "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["n_passage_words"] * (passages is not None)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for text, *parts in zip(*batch.columns[1:]):
                    data = (text.as_py() or "").encode()
                    spans, shared = (merged(a.values.to_numpy(), b.values.to_numpy()) if a.is_valid and len(a) else [] for a, b in (parts[:2], parts[2:]))
                    digest, at = hashlib.sha256(), 0
                    for a, b in spans:
                        digest.update(data[at:a])
                        at = b
                    digest.update(data[at:])
                    out.append((len(data), sum(b - a for a, b in spans), len(spans), digest.hexdigest(), sum(b - a for a, b in shared)))
                kinds = [pa.int64()] * 3 + [pa.string(), pa.int64()]
                columns = [batch.column(0), *(pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds))]
                yield pa.RecordBatch.from_arrays(columns[: len(names)], names=names)

        kinds = ["bigint"] * 4 + ["string", "bigint"]
        return rows.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))


def merged(starts: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the bytes from each start on."""
    order = np.argsort(starts, kind="stable")
    low, high = starts[order].astype(np.int64), np.maximum.accumulate((starts.astype(np.int64) + sizes)[order])
    cut = np.flatnonzero(low[1:] > high[:-1]) + 1
    return list(zip(low[np.concatenate([[0], cut])].tolist(), high[np.concatenate([cut - 1, [len(high) - 1]])].tolist()))
