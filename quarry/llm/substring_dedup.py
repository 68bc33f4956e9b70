"""Repeated paragraphs by MinHash banding.

A paragraph is a line of a text with at least ``min_words`` words (shorter
lines are headings, licence lines and chance repeats and are left alone). Its
set is its distinct 5-word shingles. ``BANDS`` bands of ``ROWS`` minhashes find
a pair of similarity 0.75 with probability 1 - (1 - 0.75^2)^10 = 0.9997, and
higher ones more surely. Paragraphs that collide in a band are compared by the
exact Jaccard similarity of their sets, links are joined into components, and
all but the first paragraph (smallest doc_id, then line) of a component are
removals.

Paragraphs of equal words are one class before any key is made, so a paragraph
that a third of the corpus repeats is one row in the joins.

``repeated_spans`` looks at words alone, whatever the lines: every run of
``RUN`` words that occurs twice anywhere is found. Of each window of RUN words
the smallest hash of ANCHOR successive words is its anchor, so equal windows
have equal anchors; only windows with an anchor that occurs twice are compared.
``without_copies`` cuts repeated paragraphs, then such runs, out of the texts.

Defined cases: null and empty texts have no paragraphs; rows that share doc_id
and text are one document (their paragraphs have equal places and share their
fate); a repeat inside one document counts; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, few, minhashes, mix, powers, prepare, sequence_hash, shingles, signed, stored, text_bytes, units
from .linking import link_components

MIN_WORDS = 15
BANDS, ROWS = 10, 2
RUN, ANCHOR = 50, 25
_BASES = (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)
PLACE = "par int, begin int, n_bytes int, n_words int, h1 long, h2 long"


def _paragraphs(texts: list[bytes], min_words: int):
    """Words, and first word and length of each line that is long enough."""
    w = Words(texts)
    first, length = units([w.doc, w.line])
    long = length >= min_words
    return w, first[long], length[long]


def _hashes(w: Words, first: np.ndarray, length: np.ndarray):
    """Hashes of the lines' word sequences, and their words in one row."""
    at = np.repeat(first - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum()) if len(first) else np.zeros(0, dtype=np.int64)
    h = w.h[at]
    start = np.concatenate([[0], np.cumsum(length)[:-1]]) if len(first) else first
    return h, start, [signed(sequence_hash(h, start, length, b)) for b in _BASES]


def _rows(min_words: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            w, first, length = _paragraphs(text_bytes(batch.column(1)), min_words)
            h, start, (h1, h2) = _hashes(w, first, length)
            s, count = shingles(h, start, length)
            m = minhashes(s, count, bands * rows)
            key = np.zeros((len(first), bands), dtype=np.uint64)
            for j in range(rows):
                key = (key ^ m[:, j::rows]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(j + 1)
                key ^= key >> np.uint64(31)
            last = first + length - 1
            cast = lambda x: pa.array(x.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(w.doc[first])), cast(w.line[first]), cast(w.start[first]), cast(w.end[last] - w.start[first]),
                 cast(length), pa.array(h1), pa.array(h2),
                 pa.ListArray.from_arrays(np.arange(0, key.size + 1, bands, dtype=np.int32), pa.array(signed(key.ravel())))],
                names=["doc_id", "par", "begin", "n_bytes", "n_words", "h1", "h2", "keys"])
    return run


def _sets(min_words: int):
    """(h1, h2, s) of the lines listed for each text."""
    def run(batches):
        for batch in batches:
            wanted = batch.column(1).to_pylist()
            w, first, length = _paragraphs(text_bytes(batch.column(0)), min_words)
            keep = np.array([int(line) in wanted[d] for d, line in zip(w.doc[first], w.line[first], strict=True)], dtype=bool) if len(first) else np.zeros(0, bool)
            first, length = first[keep], length[keep]
            h, start, (h1, h2) = _hashes(w, first, length)
            s, count = shingles(h, start, length)
            begin = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
            own = [np.unique(s[begin[k]:begin[k + 1]]) for k in range(len(first))]
            values = signed(np.concatenate(own)) if own else np.zeros(0, dtype=np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.ListArray.from_arrays(offsets, pa.array(values))], names=["h1", "h2", "s"])
    return run


def repeated_paragraphs(docs: DataFrame, percent: int = 75, min_words: int = MIN_WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Every paragraph that another one repeats: doc_id, par (line number),
    begin, n_bytes, n_words, h1, h2, first_doc, first_par, kept."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    pars = stored(text.mapInArrow(_rows(min_words, bands, rows), f"doc_id {kind}, {PLACE}, keys array<long>")
                      .withColumn("id", F.monotonically_increasing_id()), "pars")
    classes = stored(pars.groupBy("h1", "h2", "n_words").agg(F.min("id").alias("id"), F.min(F.struct("doc_id", "par")).alias("first"),
                                                           F.count("*").alias("copies")), "par-classes")
    reps = pars.join(classes.select("id"), "id", "left_semi")
    keys = reps.select("id", F.posexplode("keys").alias("band", "k")).select(F.xxhash64("band", "k").alias("key"), "id")

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = stored(reps.select("id", "doc_id", "par", "h1", "h2").join(ids, "id", "left_semi"), "par-wanted")
        lines = few(stored(wanted.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_set("par").alias("lines")), "par-lines"))
        texts = text.join(lines, F.col("doc_id").eqNullSafe(F.col("_doc"))).select("text", "lines")
        sets = texts.mapInArrow(_sets(min_words), "h1 long, h2 long, s array<long>")
        return wanted.select("id", "h1", "h2").join(sets, ["h1", "h2"]).dropDuplicates(["id"]).select("id", "s")

    comp = link_components(keys, sets_of, percent, name="par")
    found = classes.join(comp, "id", "left").where("comp is not null or copies > 1").withColumn("comp", F.coalesce("comp", "id"))
    lowest = found.groupBy("comp").agg(F.min("first").alias("lowest"))
    of_class = stored(found.join(lowest, "comp").select("h1", "h2", "n_words", "lowest"), "par-found")
    out = pars.drop("keys", "id").join(of_class, ["h1", "h2", "n_words"])
    return out.select("doc_id", "par", "begin", "n_bytes", "n_words", "h1", "h2", F.col("lowest.doc_id").alias("first_doc"),
                      F.col("lowest.par").alias("first_par"),
                      (F.col("doc_id").eqNullSafe(F.col("lowest.doc_id")) & (F.col("par") == F.col("lowest.par"))).alias("kept"))


def _cut(batches):
    """Texts without the listed lines; a line goes only if its words are the listed ones."""
    for batch in batches:
        texts, out = text_bytes(batch.column(0)), []
        for t, listed in zip(texts, batch.column(1).to_pylist(), strict=True):
            gone = {(x["par"], x["h1"], x["h2"]) for x in listed or []}
            if gone:
                w = Words([t])
                first, length = units([w.line])
                _, _, (h1, h2) = _hashes(w, first, length)
                drop = {int(line) for line, a, b in zip(w.line[first], h1, h2, strict=True) if (int(line), int(a), int(b)) in gone}
                t = b"\n".join(x for i, x in enumerate(t.split(b"\n")) if i not in drop)
            out.append(t)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string()), *batch.columns[2:]], names=["text", *batch.schema.names[2:]])


def without_repeats(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents without removed paragraphs (n_chars follows); documents
    of which nothing is left go. Other columns stay as they are."""
    gone = (found.where(~F.col("kept")).groupBy(F.col("doc_id").alias("__doc"))
                 .agg(F.collect_set(F.struct("par", "h1", "h2")).alias("__gone")))
    return _replaced(docs, docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__doc")), "left"), _cut)


def _replaced(docs: DataFrame, joined: DataFrame, cut) -> DataFrame:
    """``docs`` with the texts that have something in ``__gone`` cut."""
    same = joined.where("__gone is null")
    rest = [c for c in docs.columns if c != "text"]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = "text string, " + ", ".join(f"`{c}` {kinds[c]}" for c in rest)
    changed = joined.where("__gone is not null").select("text", "__gone", *rest).mapInArrow(cut, schema).where(F.length(F.trim("text")) > 0)
    if "n_chars" in rest:
        changed = changed.withColumn("n_chars", F.length("text").cast(kinds["n_chars"]))
    return same.select(*docs.columns).unionByName(changed.select(*docs.columns))


def _rolling(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hash of every run of ``width`` words."""
    if len(h) < width:
        return np.zeros(0, dtype=np.uint64)
    b, back = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(h ^ b) * powers(b, len(h)), dtype=np.uint64)])
    return mix((total[width:] - total[:-width]) * powers(back, len(h))[:len(h) - width + 1])


def _windows(w: Words):
    """First words of the runs of RUN words inside a text, places and hashes of their anchors."""
    grams = _rolling(w.h, ANCHOR, _BASES[0])
    if len(w.h) < RUN:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), grams[:0]
    first = np.flatnonzero(w.doc[:len(w.h) - RUN + 1] == w.doc[RUN - 1:])
    views = np.lib.stride_tricks.sliding_window_view(grams, RUN - ANCHOR + 1)
    at = np.concatenate([views[first[a:a + 65536]].argmin(axis=1) + first[a:a + 65536] for a in range(0, len(first), 65536)] or [first])
    return first, at, grams[at]


def _anchors(batches):
    for batch in batches:
        w = Words(text_bytes(batch.column(2)))
        _, at, gram = _windows(w)
        at, one = np.unique(at, return_index=True)
        own = pa.array(w.doc[at])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(signed(gram[one]))], names=["doc_id", "row", "g"])


def _runs(batches):
    """The runs whose anchors are among those listed for the text."""
    for batch in batches:
        w = Words(text_bytes(batch.column(2)))
        first, _, gram = _windows(w)
        gram, keep = signed(gram), np.zeros(len(first), dtype=bool)
        listed = batch.column(3)
        begin, length = units([w.doc[first]])
        for b, n in zip(begin.tolist(), length.tolist(), strict=True):
            keep[b:b + n] = np.isin(gram[b:b + n], listed[int(w.doc[first[b]])].values.to_numpy())
        first = first[keep]
        start, size = units([w.doc])
        word = first - np.repeat(start, size)[first]
        own = pa.array(w.doc[first])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(own), batch.column(1).take(own), pa.array(word), pa.array(w.start[first]), pa.array(w.end[first + RUN - 1] if len(first) else first),
             *(pa.array(signed(_rolling(w.h, RUN, x)[first])) for x in _BASES)], names=["doc_id", "row", "word", "begin", "end", "h1", "h2"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Stretches of words that lie in runs of RUN words which occur more than
    once: doc_id, first_word, n_words, begin, n_bytes, kept. ``kept`` marks the
    first places (smallest doc_id, then word); the others are repeats. A word
    may lie in stretches of both kinds."""
    return _spans(docs).drop("row")


def _spans(docs: DataFrame) -> DataFrame:
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = docs.select("doc_id", F.col("text").cast("string").alias("text")).select("doc_id", F.xxhash64("text").alias("row"), "text")
    anchors = stored(text.mapInArrow(_anchors, f"doc_id {kind}, row long, g long"), "span-anchors")
    often = anchors.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g")
    listed = stored(anchors.join(often, "g").groupBy(F.col("doc_id").alias("_doc"), F.col("row").alias("_row"))
                           .agg(F.collect_set("g").alias("gs")), "span-listed")
    some = text.join(listed, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("row") == F.col("_row"))).select("doc_id", "row", "text", "gs")
    runs = stored(some.mapInArrow(_runs, f"doc_id {kind}, row long, word long, begin long, end long, h1 long, h2 long"), "span-runs")
    place = F.struct("doc_id", "row", "word")
    firsts = runs.groupBy("h1", "h2").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("not (lo <=> hi)").select("h1", "h2", "lo")
    met = runs.join(firsts, ["h1", "h2"]).select("doc_id", "row", "word", "begin", "end", place.eqNullSafe(F.col("lo")).alias("kept"))
    order = Window.partitionBy("doc_id", "row", "kept").orderBy("word")
    new = F.coalesce(F.col("word") > F.lag("word").over(order) + RUN, F.lit(True)).cast("int")
    spans = met.withColumn("new", new).withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = spans.groupBy("doc_id", "row", "kept", "span").agg(F.min("word").alias("first_word"), (F.max("word") - F.min("word") + RUN).alias("n_words"),
                                                             F.min("begin").alias("begin"), (F.max("end") - F.min("begin")).alias("n_bytes"))
    return out.select("doc_id", "row", "first_word", "n_words", "begin", "n_bytes", "kept")


def _cut_stretches(batches):
    """Texts without the listed stretches of bytes, nor the blanks after them; empty if only white space is left."""
    for batch in batches:
        out = []
        for t, listed in zip(text_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            rest, at = [], 0
            for x in sorted(listed, key=lambda x: x["begin"]):
                rest.append(t[at:x["begin"]])
                at = x["begin"] + x["n_bytes"]
                while t[at:at + 1] in (b" ", b"\t"):
                    at += 1
            t = b"".join([*rest, t[at:]])
            out.append(t if t.strip() else b"")
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string()), *batch.columns[2:]], names=["text", *batch.schema.names[2:]])


def without_passages(docs: DataFrame) -> DataFrame:
    """The documents without runs of RUN words that occur at an earlier place,
    whatever the lines (n_chars follows); documents of which nothing is left
    go. The first place of every run stays: of each word that is cut an
    earlier copy is left, the smallest place being never a repeat. Other
    columns stay as they are."""
    gone = stored(_spans(docs).where(~F.col("kept")).groupBy(F.col("doc_id").alias("__doc"), F.col("row").alias("__row"))
                              .agg(F.collect_list(F.struct("begin", "n_bytes")).alias("__gone")), "span-gone")
    own = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__row"))
    return _replaced(docs, docs.join(gone, own, "left"), _cut_stretches)


def without_copies(docs: DataFrame) -> DataFrame:
    """The documents without repeated paragraphs, then without repeated passages."""
    return without_passages(stored(without_repeats(docs, repeated_paragraphs(docs)), "par-cut"))
