"""Exact removal of repeated passages: suffix sorting by difference covers.

A byte is removed if it lies in a string of ``LENGTH`` bytes that also starts in a document
with a smaller id. All strings of that length ("windows") would be too many to move, so:

1. Every document belongs to a batch. A batch names each window by the smallest hash of the
   ``GRAM``-byte grams in it; equal windows have equal names, and about one name stands for
   seventeen windows. Names go to buckets by hash.
2. A bucket sends back the names that more than one document has. No window with another name
   can repeat.
3. A batch sends the stretches of windows under a repeated name to the name's bucket, each
   different stretch once, with the smallest id that has it in the batch.
4. A bucket sorts the suffixes of its stretches to the depth of a window by the difference
   cover {1, 2} modulo 3: triples at sampled positions are sorted and named, the names recurse
   as triples of names, and remaining suffixes are merged through the sampled ones next to
   them. Equal neighbours in that order are equal windows; their smallest id goes back.
5. A batch marks the windows whose smallest id is below the document's own.

The text is shuffled once, by batch; what moves between batches and buckets are packed arrays.
A passage that very many documents share is sent once per batch, so no bucket grows with it.
Names are only a filter: windows are compared by their bytes.

Defined results: a null text is empty. Null ids count as larger than all others and do not
remove from each other; neither do rows with the same id. Other columns are not read.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflux.llm.common import partitions, row_bytes, table
from odflux.llm.registry import query

LENGTH = 50
GRAM = 18
_GRAMS = LENGTH - GRAM + 1  # grams of a window
_SLICE = 1 << 18  # windows looked at together
BUCKETS = 6  # per shuffle partition; a task sorts one at a time
_LAST = np.iinfo(np.int64).max
U = np.uint64
_MOVE = pa.schema([("to", pa.int64()), ("batch", pa.int64()), ("payload", pa.binary())])


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position, by doubling; never zero."""
    piece, size = (data.astype(U) + U(1)) * U(0x9E3779B97F4A7C15), 1
    piece ^= piece >> U(29)
    whole, have, left = None, 0, GRAM
    while True:
        if left & 1:
            if whole is None:
                whole, have = piece, size
            else:
                n = len(data) - have - size + 1
                whole = whole[:n] * U(0xD6E8FEB86659FD93) + piece[have : have + n]
                whole ^= whole >> U(32)
                have += size
        left >>= 1
        if not left:
            return whole | U(1)
        n = len(piece) - size
        piece = piece[:n] * U(0xBF58476D1CE4E5B9) + piece[size : size + n]
        piece ^= piece >> U(31)
        size *= 2


def _slices(size: int):
    """Parts of a run of bytes: (first window, bytes end); windows of two parts are adjacent."""
    at = 0
    while at + LENGTH <= size:
        end = min(size, at + _SLICE + LENGTH - 1)
        yield at, end
        at = end - LENGTH + 1


def _window_names(data: np.ndarray) -> np.ndarray:
    """The smallest gram hash of every window of ``data``."""
    low = _gram_hashes(data)
    grams, span = low, 1
    while 2 * span <= _GRAMS:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < _GRAMS:
        n = len(grams) - _GRAMS + 1
        low = np.minimum(low[:n], low[_GRAMS - span : _GRAMS - span + n])
    return low


def _pieces(texts: pa.ChunkedArray, ids: np.ndarray):
    """The batch in parts: joined bytes, window names (zero: crosses two documents), the document
    of each window, and where each document's bytes start in the part. A long document comes in
    several parts; ``offset`` is where a part starts in it."""
    held: list[tuple[int, int, memoryview]] = []
    size = 0

    def build():
        data = np.concatenate([np.frombuffer(m, np.uint8) for _, _, m in held])
        lengths = np.array([len(m) for _, _, m in held])
        starts = np.cumsum(lengths) - lengths
        windows = len(data) - LENGTH + 1
        at = np.repeat(np.arange(len(held)), lengths)[:windows]
        names = _window_names(data)
        names[np.arange(windows) + LENGTH > (starts + lengths)[at]] = 0
        doc = np.array([d for d, _, _ in held])[at]
        place = np.arange(windows) - starts[at] + np.array([o for _, o, _ in held])[at]
        return data, names, doc, place

    for d, body in enumerate(row_bytes(texts)):
        for first, end in _slices(len(body)):
            held.append((d, first, body[first:end]))
            size += end - first
            if size > _SLICE:
                yield build()
                held, size = [], 0
    if held:
        yield build()


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(_LAST).to_numpy().astype(np.int64)


def _dump(*arrays: np.ndarray) -> bytes:
    return pickle.dumps(arrays, protocol=5)


def _moves(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    to, batch, payload = zip(*rows) if rows else ((), (), ())
    return pa.table([pa.array(to, pa.int64()), pa.array(batch, pa.int64()), pa.array(payload, pa.binary())], schema=_MOVE)


def _collect_names(buckets: int):
    def run(part: pa.Table) -> pa.Table:
        """Different names of the batch; whether more than one document has them."""
        batch, ids = part.column("batch")[0].as_py(), _ids(part.column("doc_id"))
        names, least, most = [], [], []
        for _, name, doc, _ in _pieces(part.column("text"), ids):
            change = np.concatenate(([True], (name[1:] != name[:-1]) | (doc[1:] != doc[:-1]))) & (name > 0)
            n, d = name[change], ids[doc[change]]
            n, lo, hi = _extremes(n, d, d)
            names.append(n), least.append(lo), most.append(hi)
        if not names:
            return _moves([])
        n, lo, hi = _extremes(np.concatenate(names), np.concatenate(least), np.concatenate(most))
        to = (n % U(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        n, many, to = n[order], (lo < hi)[order], to[order]
        cuts = np.searchsorted(to, np.arange(buckets + 1))
        return _moves([
            (b, batch, _dump(n[cuts[b] : cuts[b + 1]], many[cuts[b] : cuts[b + 1]]))
            for b in range(buckets) if cuts[b + 1] > cuts[b]
        ])

    return run


def _extremes(key: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(key):
        return key, low, high
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first)


def _repeated_names(part: pa.Table) -> pa.Table:
    """For each batch its names that another document has as well."""
    batches = part.column("batch").to_pylist()
    got = [pickle.loads(p.as_py()) for p in part.column("payload")]
    names, many = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
    order = np.argsort(names, kind="stable")
    sorted_names = names[order]
    equal = sorted_names[1:] == sorted_names[:-1]
    again = many.copy()
    again[order[1:][equal]] = True
    again[order[:-1][equal]] = True
    out, at = [], 0
    for batch, (n, _) in zip(batches, got):
        kept = n[again[at : at + len(n)]]
        at += len(n)
        if len(kept):
            out.append((batch, batch, _dump(kept)))
    return _moves(out)


def _stretches(data: np.ndarray, name: np.ndarray, doc: np.ndarray, repeated: np.ndarray):
    """Runs of windows under one repeated name in one document: first window, number, name."""
    if not len(repeated) or not len(name):
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, U),)
    change = np.flatnonzero(np.concatenate(([True], (name[1:] != name[:-1]) | (doc[1:] != doc[:-1]))))
    count = np.diff(np.append(change, len(name)))
    n = name[change]
    hit = repeated[np.minimum(np.searchsorted(repeated, n), len(repeated) - 1)] == n
    return change[hit], count[hit], n[hit]


def _stretch_hashes(data: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A content hash of each stretch, from its gram hashes and its length."""
    grams = _gram_hashes(data)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(len(grams) + 1, U(0xBF58476D1CE4E5B9)))
        total = np.concatenate(([U(0)], np.cumsum(grams * powers[: len(grams)], dtype=U)))
        inverse = np.cumprod(np.full(len(grams) + 1, U(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))))
        part = (total[first + count - 1 + _GRAMS] - total[first]) * inverse[first]
        return (part ^ (part >> U(29))) * U(0x94D049BB133111EB) + count.astype(U)


def _repeated_of(part: pa.Table) -> np.ndarray:
    got = [pickle.loads(p.as_py())[0] for p in part.column("payload")]
    return np.sort(np.concatenate(got)) if got else np.empty(0, U)


def _collect_stretches(buckets: int):
    def run(docs: pa.Table, messages: pa.Table) -> pa.Table:
        """Different stretches of the batch with the smallest and largest id that has them."""
        if not docs.num_rows:
            return _moves([])
        batch, ids, repeated = docs.column("batch")[0].as_py(), _ids(docs.column("doc_id")), _repeated_of(messages)
        parts = []
        for data, name, doc, _ in _pieces(docs.column("text"), ids):
            first, count, n = _stretches(data, name, doc, repeated)
            if not len(first):
                continue
            key = _stretch_hashes(data, first, count)
            own = ids[doc[first]]
            _, place, back = np.unique(key, return_index=True, return_inverse=True)
            lo, hi = np.full(len(place), _LAST), np.full(len(place), np.iinfo(np.int64).min)
            np.minimum.at(lo, back, own)
            np.maximum.at(hi, back, own)
            length = count[place] + LENGTH - 1
            body = data[_spans(first[place], length)]
            parts.append((key[place], n[place], length, lo, hi, body))
        if not parts:
            return _moves([])
        key, n, length, lo, hi, body = (np.concatenate(x) for x in zip(*parts))
        begin = np.cumsum(length) - length
        _, place, back = np.unique(key, return_index=True, return_inverse=True)
        low, high = np.full(len(place), _LAST), np.full(len(place), np.iinfo(np.int64).min)
        np.minimum.at(low, back, lo)
        np.maximum.at(high, back, hi)
        key, n, length, begin = key[place], n[place], length[place], begin[place]
        to = (n % U(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[order], np.arange(buckets + 1))
        pack, out = zstandard.ZstdCompressor(level=1).compress, []
        for b in range(buckets):
            o = order[cuts[b] : cuts[b + 1]]
            if len(o):
                text = pack(body[_spans(begin[o], length[o])].tobytes())
                out.append((b, batch, _dump(key[o], length[o].astype(np.int32), low[o], (low < high)[o], text)))
        return _moves(out)

    return run


def _spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All positions of the given stretches, one after another."""
    total = int(length.sum())
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(total)


# --- Suffix sorting to the depth of a window ----------------------------------------------------

def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Ranks of composite keys, the first key being the most significant; equal keys tie."""
    packed = keys[0].astype(U)
    top = int(packed.max(initial=0)) + 1
    for key in keys[1:]:
        width = int(key.max(initial=0)) + 1
        if top * width >= 1 << 64:
            packed = np.unique(packed, return_inverse=True)[1].astype(U)
            top = int(packed.max(initial=0)) + 1
        if top * width >= 1 << 64:
            key = np.unique(key, return_inverse=True)[1].astype(U)
            width = int(key.max(initial=0)) + 1
        packed = packed * U(width) + key.astype(U)
        top *= width
    return np.unique(packed, return_inverse=True)[1]


def window_classes(text: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """A class number for each window position; equal numbers mean equal LENGTH-byte strings.

    Difference cover {1, 2} modulo 3. Sampled positions get ranks of 18 bytes from sorted
    triples of six-byte letters, then ranks of 48 bytes from sorted triples of those ranks,
    15 positions apart, which stay in the sample. Windows at sampled positions are ranked by
    that rank and the two bytes behind it; the others are merged through the ranks of the next
    two positions, both of which are sampled as seen from one of the two sampled classes.
    """
    wide = np.concatenate((text, np.zeros(LENGTH + 8, np.uint8))).astype(U)
    letter = np.zeros(len(text) + LENGTH, U)
    for k in range(6):
        letter = letter * U(256) + wide[k : k + len(letter)]
    sampled = np.zeros(len(text) + LENGTH, bool)
    for step in (0, 1, 2):
        at = windows + step
        sampled[at[at % 3 != 0]] = True
    deep = np.flatnonzero(sampled)  # need ranks of 48 bytes
    sampled[deep + 15] = True
    sampled[deep + 30] = True
    at = np.flatnonzero(sampled)
    rank18 = np.zeros(len(sampled), np.int64)
    rank18[at] = _ranks(letter[at], letter[np.minimum(at + 6, len(letter) - 1)], letter[np.minimum(at + 12, len(letter) - 1)])
    rank48 = np.zeros(len(sampled), np.int64)
    rank48[deep] = _ranks(rank18[deep], rank18[deep + 15], rank18[deep + 30])

    residue = windows % 3
    classes = np.empty(len(windows), np.int64)
    inside = residue != 0
    w = windows[inside]
    classes[inside] = _ranks(rank48[w], wide[w + 48] * U(256) + wide[w + 49])
    rest = windows[~inside]
    if not len(rest):
        return classes
    # A position of residue 0 meets residue 1 one byte on and residue 2 two bytes on.
    base = int(classes[inside].max(initial=-1)) + 1
    merged = np.full(len(rest), -1)
    for other in (1, 2):
        here = windows[residue == other]
        both = np.concatenate((rest, here))
        head = wide[both] if other == 1 else wide[both] * U(256) + wide[both + 1]
        tail = wide[both + 49] if other == 1 else np.zeros(len(both), U)
        key = _ranks(rank48[both + other], head, tail)
        known = np.full(int(key.max()) + 1, -1)
        known[key[len(rest) :]] = classes[residue == other]
        found = known[key[: len(rest)]]
        merged = np.where(merged < 0, found, merged)
        if other == 1:
            alone = key[: len(rest)]
    classes[~inside] = np.where(merged >= 0, merged, base + alone)
    return classes


def _smallest_ids(part: pa.Table) -> pa.Table:
    """For each batch and stretch: runs of windows with the smallest id that has the window."""
    batches = part.column("batch").to_pylist()
    got = [pickle.loads(p.as_py()) for p in part.column("payload")]
    key = np.concatenate([g[0] for g in got])
    length = np.concatenate([g[1] for g in got]).astype(np.int64)
    low = np.concatenate([g[2] for g in got])
    many = np.concatenate([g[3] for g in got])
    unpack = zstandard.ZstdDecompressor().decompress
    text = np.concatenate([np.frombuffer(unpack(g[4]), np.uint8) for g in got])
    source = np.repeat(np.arange(len(got)), [len(g[0]) for g in got])
    begin = np.cumsum(length) - length
    _, place, back = np.unique(key, return_index=True, return_inverse=True)
    least = np.full(len(place), _LAST)
    np.minimum.at(least, back, low)
    text = text[_spans(begin[place], length[place])]
    count = length[place] - LENGTH + 1
    own = np.cumsum(length[place]) - length[place]
    windows = _spans(own, count)
    classes = window_classes(text, windows)
    smallest = np.full(int(classes.max(initial=0)) + 1, _LAST)
    np.minimum.at(smallest, classes, np.repeat(least, count))
    smallest = smallest[classes]
    # Runs of equal ids inside a stretch.
    stretch = np.repeat(np.arange(len(place)), count)
    change = np.flatnonzero(np.concatenate(([True], (smallest[1:] != smallest[:-1]) | (stretch[1:] != stretch[:-1]))))
    run_of, run_id = stretch[change], smallest[change]
    run_from = change - (np.cumsum(count) - count)[run_of]
    run_size = np.diff(np.append(change, len(smallest)))
    from_run = np.searchsorted(run_of, np.arange(len(place) + 1))
    runs = from_run[back + 1] - from_run[back]
    index = _spans(from_run[back], runs)
    entry = np.repeat(np.arange(len(key)), runs)
    useful = (run_id[index] < low[entry]) | many[entry]
    index, entry = index[useful], entry[useful]
    cuts = np.searchsorted(source[entry], np.arange(len(got) + 1))
    out = []
    for k, batch in enumerate(batches):
        e, r = entry[cuts[k] : cuts[k + 1]], index[cuts[k] : cuts[k + 1]]
        if len(e):
            out.append((batch, batch, _dump(key[e], run_from[r], run_size[r], run_id[r])))
    return _moves(out)


def _remove(docs: pa.Table, messages: pa.Table) -> pa.Table:
    """What is left of each document of the batch."""
    texts, kind = docs.column("text"), docs.schema.field("doc_id").type
    ids = _ids(docs.column("doc_id"))
    got = [pickle.loads(p.as_py()) for p in messages.column("payload")]
    bodies = list(row_bytes(texts))
    marks: dict[int, list] = {}
    if got:
        key, start, size, least = (np.concatenate(x) for x in zip(*got))
        order = np.argsort(key, kind="stable")
        key, start, size, least = key[order], start[order], size[order], least[order]
        names = np.unique(key)
        for data, name, doc, place in _pieces(texts, ids):
            first, count = _all_stretches(name, doc)
            have = _stretch_hashes(data, first, count)
            hit = names[np.minimum(np.searchsorted(names, have), len(names) - 1)] == have
            first, have = first[hit], have[hit]
            lo, hi = np.searchsorted(key, have), np.searchsorted(key, have, side="right")
            run = _spans(lo, hi - lo)
            at = np.repeat(first, hi - lo)
            gone = least[run] < ids[doc[at]]
            run, at = run[gone], at[gone]
            who, begin = doc[at], place[at] + start[run]
            end = begin + size[run] + LENGTH - 1
            order = np.argsort(who, kind="stable")
            who, begin, end = who[order], begin[order], end[order]
            for d, a, b in _by(who, begin, end):
                marks.setdefault(d, []).append((a, b))
    kept, removed, spans = [], [], []
    for d, body in enumerate(bodies):
        if d not in marks:
            kept.append(bytes(body)), removed.append(0), spans.append(0)
            continue
        step = np.zeros(len(body) + 1, np.int64)
        for a, b in marks[d]:
            np.add.at(step, a, 1)
            np.add.at(step, b, -1)
        gone = np.cumsum(step[:-1]) > 0
        kept.append(np.frombuffer(body, np.uint8)[~gone].tobytes())
        removed.append(int(gone.sum()))
        spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
    return pa.table({
        "doc_id": docs.column("doc_id").cast(kind), "n_bytes": pa.array([len(b) for b in bodies], pa.int64()),
        "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()),
        "kept": pa.array(kept, pa.binary()),
        # A cut inside a character leaves bytes that are no character; they go as well.
        "kept_text": pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()), **{c: docs.column(c) for c in docs.column_names if c.startswith("pass_")},
    })


def _all_stretches(name: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    change = np.flatnonzero(np.concatenate(([True], (name[1:] != name[:-1]) | (doc[1:] != doc[:-1]))))
    count = np.diff(np.append(change, len(name)))
    real = name[change] > 0
    return change[real], count[real]


def _by(who: np.ndarray, begin: np.ndarray, end: np.ndarray):
    if len(who):
        cuts = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1]))).tolist() + [len(who)]
        for a, b in zip(cuts, cuts[1:]):
            yield int(who[a]), begin[a:b], end[a:b]


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, kept_text) and the columns of ``keep`` as pass_0, pass_1, ..."""
    n = partitions(docs.sparkSession)
    buckets = BUCKETS * n
    carried = [F.col(c).alias(f"pass_{k}") for k, c in enumerate(keep)]
    batched = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *carried,
        F.pmod(F.xxhash64(doc_id), F.lit(n)).alias("batch"),
    ).repartition(n, "batch")
    move = "to long, batch long, payload binary"
    names = batched.groupBy("batch").applyInArrow(_collect_names(buckets), move)
    again = names.groupBy("to").applyInArrow(_repeated_names, move)
    stretches = batched.groupBy("batch").cogroup(again.groupBy("to")).applyInArrow(_collect_stretches(buckets), move)
    least = stretches.groupBy("to").applyInArrow(_smallest_ids, move)
    types = {f.name: f.dataType.simpleString() for f in batched.schema}
    out = f"doc_id {types['doc_id']}, n_bytes long, n_removed long, n_spans long, kept binary, kept_text string" + "".join(
        f", pass_{k} {types[f'pass_{k}']}" for k in range(len(keep))
    )
    return batched.groupBy("batch").cogroup(least.groupBy("to")).applyInArrow(_remove, out)


@query("op6_suffix_array_dedup")
def op6(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
