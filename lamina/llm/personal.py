"""Personal data: base patterns, and contexts bootstrapped from what they find."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import lean, salted, text_slices, written

KINDS = ("email", "ip", "card", "phone")
#: Rounds at most, least share of a pattern's values that are personal, least accepted values behind a pattern, least score of an accepted value.
ROUNDS, LEAST_SHARE, LEAST_SEEDS, LEAST_SCORE = 6, 0.8, 4, 0.8
#: Characters of a word next to a value that belong to its pattern, the nearest ones: a word may be a whole text.
CONTEXT = 24
#: Rows with discovered spans, and such spans, up to which they are broadcast; more are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_SPANS = 100_000, 1_000_000

_HINT = re.compile(r"[0-9@]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_EDGE = ".,;:!?()[]{}<>\"'`|*"


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ that a domain follows, with all local characters before it that no earlier match holds: linear, unlike a search from every character."""
    done = 0
    for m in _DOMAIN.finditer(text):
        at = start = m.start()
        step = 64
        while True:  # walk left in growing steps to the last character that cannot be local
            low = max(done, start - step)
            part = text[low:start]
            tail = _LOCAL.search(part) if len(part) <= 64 else None
            cut = tail.start() if tail else _last(part)
            start = low + cut
            if cut or low == done:
                break
            step *= 2
        if start < at:
            done = m.end()
            yield start, m.end()


def _last(part: str) -> int:
    """Index after the last character of part that cannot be local."""
    found = _NOT_LOCAL.search(part[::-1])
    return len(part) - found.start() if found else 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all base matches, by start and then kind."""
    if not _HINT.search(text):
        return []
    spans = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    spans += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                spans.append((m.start(), 2, m.end()))
    if "+" in text:
        spans += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(spans)


def _instances(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int, int, list[str]]]:
    """(text, start, end, kind or -1, patterns) of base spans and of other tokens with a digit or @."""
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]

    def patterns(i: int, j: int, lead: str, start: int, end: int) -> list[str]:
        left = [text[a:b].lower() for a, b in tokens[max(0, i - 2) : i]] + ([lead.lower()] if lead else [])
        right = text[end : tokens[j][1]].lower() + (" " + text[slice(*tokens[j + 1])].lower() if j + 1 < len(tokens) else "")
        left, right = [w[-CONTEXT:] for w in left[-2:]], right.strip()[:CONTEXT]
        return ([f"L {' '.join(left)}"] if len(left) == 2 else []) + ([f"B {left[-1]} _ {right}"] if left and right else [])

    k = 0
    covered = 0
    for i, (a, b) in enumerate(tokens):
        first = True
        while k < len(spans) and spans[k][0] < b:
            s, kind, e = spans[k]
            j = i
            while j + 1 < len(tokens) and tokens[j + 1][0] < e:
                j += 1
            yield text[s:e], s, e, kind, patterns(i, j, text[a:s], s, e)
            covered, first = max(covered, e), False
            k += 1
        if first and a >= covered and _HINT.search(text, a, b):
            s, e = a, b
            while s < e and text[s] in _EDGE:
                s += 1
            while e > s and text[e - 1] in _EDGE:
                e -= 1
            cut = max(text.rfind("=", s, e), text.rfind(":", s, e)) + 1
            if s < cut < e and _HINT.search(text, cut, e):
                s = cut
            if e - s >= 5 and _HINT.search(text, s, e):
                yield text[s:e], s, e, -1, patterns(i, i, text[a:s].rstrip("\"'"), s, e)


def scan(rows: DataFrame) -> DataFrame:
    """Base spans and context instances of the whole texts (null: empty) of rows (row, text): (row, base array of (start, kind, stop), seen array of (value, start, stop, kind, patterns))."""
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())])
    seen = pa.struct([("value", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.int32()), ("patterns", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_slices(batch, 1):
                found, near = [], []
                for text in texts.to_pylist():
                    spans = base_spans(text)
                    found.append([dict(zip(("start", "kind", "stop"), s)) for s in spans])
                    near.append([dict(zip(("value", "start", "stop", "kind", "patterns"), x)) for x in _instances(text, spans)] if spans or _HINT.search(text) else [])
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found, pa.list_(span)), pa.array(near, pa.list_(seen))], ["row", "base", "seen"])

    row_type = rows.schema["row"].dataType.simpleString()
    return rows.select("row", "text").mapInArrow(lean(run), f"row {row_type}, base array<struct<start:int,kind:int,stop:int>>, seen array<struct<value:string,start:int,stop:int,kind:int,patterns:array<string>>>")


def discover(seen: DataFrame, rounds: int = ROUNDS, least_share: float = LEAST_SHARE, least_seeds: int = LEAST_SEEDS, least_score: float = LEAST_SCORE) -> DataFrame:
    """Values that high-confidence patterns mark as personal: (value, kind int).

    seen has rows (value, kind or -1, pattern). Base matches are seeds of score 1 and accepted from the start. A round induces patterns
    anew from all values accepted so far: a pattern counts for a kind with least_seeds accepted values of that kind behind it, and its score is
    the sum of their scores over all its distinct values. A value's score is one minus the product of (1 - score) over its
    patterns of at least least_share; from least_score on it is accepted, and in the next round speaks for its other patterns.
    Ties take the kind listed first. Rounds end when no value is new, or after `rounds` of them.
    """
    edges = written(seen.where("value is not null and pattern is not null").groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "contexts")
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    open_edges = edges.where("kind < 0").select("pattern", "value")
    seeds = edges.where("kind >= 0").groupBy("pattern", "kind").agg(F.count("*").alias("behind"), F.count("*").cast("double").alias("got"))
    accepted, known = None, -1
    for _ in range(rounds):
        support = seeds
        if accepted is not None:
            more = salted(open_edges, "value", accepted).groupBy("pattern", "kind").agg(F.count("*").alias("behind"), F.sum("score").alias("got"))
            support = seeds.unionByName(more).groupBy("pattern", "kind").agg(F.sum("behind").alias("behind"), F.sum("got").alias("got"))
        trusted = support.where(F.col("behind") >= least_seeds).join(sizes, "pattern").withColumn("share", F.col("got") / F.col("n"))
        trusted = trusted.where(F.col("share") >= least_share).select("pattern", "kind", "share")
        scores = salted(open_edges, "pattern", trusted).groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least("share", F.lit(0.999)))))).alias("score"))
        best = scores.where(F.col("score") >= least_score).groupBy("value").agg(F.max(F.struct("score", (-F.col("kind")).alias("order"))).alias("top"))
        accepted = written(best.select("value", (-F.col("top.order")).alias("kind"), F.col("top.score").alias("score")), "accepted")
        was, known = known, accepted.count()
        if known in (0, was):  # scores only rise, so as many values are the same values
            break
    return accepted.select("value", "kind")


def _found(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For rows (row, text): (row, base), and for rows with discovered spans (row, more)."""
    scanned = written(scan(rows), "personal")
    seen = scanned.select("row", F.explode("seen").alias("s")).select("row", "s.*")
    values = discover(seen.select("value", "kind", F.explode("patterns").alias("pattern")))
    places = salted(seen.where("kind < 0").select("row", "value", "start", "stop"), "value", values)
    more = places.groupBy("row").agg(F.collect_set(F.struct("start", "kind", "stop")).alias("more"))
    return scanned.select("row", "base"), written(more, "discovered")


def _with_more(left: DataFrame, more: DataFrame) -> DataFrame:
    """left (row, ...) with the discovered spans of its rows (null: none); only a large number of them moves left's rows."""
    rows, spans = more.agg(F.count("*"), F.coalesce(F.sum(F.size("more")), F.lit(0))).first()
    if not rows:
        return left.withColumn("more", F.lit(None).cast(more.schema["more"].dataType))
    return left.join(F.broadcast(more) if rows <= BROADCAST_ROWS and spans <= BROADCAST_SPANS else more, "row", "left")


def _every(base: Column, more: Column) -> Column:
    return F.when(more.isNull(), base).otherwise(F.array_sort(F.concat(base, more)))


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of personal data in every whole text, one row for each input row: (id_col, base, spans), arrays of (start int, kind int, stop int) in code points.

    kind counts KINDS; base holds the fixed patterns' matches, spans those and the discovered ones, by start and
    then kind. Null and empty texts give empty arrays, an empty table gives no rows. Rows are told apart by a key of their own,
    so repeated rows, rows that share an id and rows with a null id each keep their own spans. Only the named columns are read,
    so others may have any name. Texts of any length are searched whole. What is shuffled are contexts of tokens with a digit
    or an @, first summed to distinct (pattern, value) pairs; the rows of one pattern or value are dealt to several parts.
    """
    rows = docs.select(F.struct(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id")).alias("row"), F.col(text_col).alias("text"))
    base, more = _found(rows)
    return _with_more(base, more).select(F.col("row.id").alias(id_col), "base", _every(F.col("base"), F.col("more")).alias("spans"))


def of_kind(spans: str, kind: int) -> Column:
    """Number of spans of one kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def spelled(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def blanked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each (start, kind, stop), in order, replaced by its kind in brackets; spans that overlap go together under the first one's kind."""
    out, done = [], 0
    for start, kind, stop in spans:
        if start >= done:
            out += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done = max(done, stop)
    return "".join(out) + text[done:]


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every found span replaced by its kind in brackets; overlapping spans are replaced together under the first one's kind.

    All columns stay as they are, whatever their names; a null text stays null and no row is added or lost. Base spans are searched again in
    the row's own text and discovered ones come back by a key made in a written copy of the rows, so ids play no part: rows
    with a null or repeated id are redacted like any other. An empty table gives an empty table.
    """
    keyed = written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")), "keyed")
    _, more = _found(keyed.select("row", F.col(f"doc.`{text_col}`").alias("text")))
    fields = [F.col(f"doc.`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    flat = _with_more(keyed, more).select(*fields, F.col("more").alias("more"))
    text_at, width, names = docs.columns.index(text_col), len(docs.columns), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, more in zip(batch.column(text_at).to_pylist(), batch.column(width).to_pylist()):
                if text is not None and (more or _HINT.search(text)):
                    text = blanked(text, sorted([*base_spans(text), *((s["start"], s["kind"], s["stop"]) for s in more or ())]))
                texts.append(text)
            arrays = [batch.column(i) for i in range(width)]
            arrays[text_at] = pa.array(texts, arrays[text_at].type)
            yield pa.RecordBatch.from_arrays(arrays, names)

    return flat.mapInArrow(lean(run), docs.schema)
