"""Personal data by fixed patterns and a character BiLSTM-CRF.

The patterns give the base spans, exactly and in linear time, over whole texts.
Their spans on a bounded sample are the labels on which the tagger is trained,
together with the ways in which such values are written that the patterns lose:
values next to other numbers, phones without a plus sign, addresses with accents or
with ``(at)`` and of invented names, colon-separated ips; and numbers that are no such
value. It then reads overlapping windows; each window is decoded by itself, and the
spans of all windows of a document are reconciled at once: of spans that overlap, the
set of the highest total weight stays. A span that reaches its window's edge is read
again in windows twice as wide, until it ends inside of one, however long it is; these
lie half a width apart, so each width costs a text at most two readings. A span that the
tagger adds must hold a checkable value of its kind and must not touch a base span.

Every kind needs a digit, an @ sign or an ``(at)``; only windows with one outside all
base spans are decoded, for no other can hold an added span.

Defined results: null text is empty and has no spans; an empty sample gives no
tagger and base spans alone; of overlapping spans of equal weight the one that ends
first stays; repeated rows are judged each; texts of any length are read whole, by
windows; other columns keep their names and values, whatever these are; an empty
table gives an empty result.
"""

from __future__ import annotations

import heapq
import ipaddress
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itinera.llm.tagger import EDGE, Tagger, symbols

# The kinds in their listed order.
KINDS = ("email", "ip", "card", "phone")
#: Characters of a window, and the step between windows.
WINDOW, STEP = 96, 48
#: Distinct windows that the tagger is trained on at most: those of least hash, half of
#: them with spans and half without.
SAMPLE_WINDOWS = 1536
#: Rewritten windows with spans that it is trained on; a third as many without.
REWRITTEN = 3 * SAMPLE_WINDOWS // 2
HIDDEN = 20
#: Gradient steps of the training, and windows in each.
TRAIN_STEPS, BATCH, RATE = 600, 32, 0.02
SEED = 7
#: Mean probability of a span's tags from which on it counts.
CONFIDENCE = 0.8

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: A sign that is written out: jo (at) example (dot) com.
AT, DOT = r"\x20?[(\[]at[)\]]\x20?", r"\x20?[(\[]dot[)\]]\x20?"
TRIGGER = re.compile(r"[0-9@]|[(\[]at[)\]]")
ADDRESS = re.compile(rf"[\w.%+-]+(?:@|{AT})[\w-]+(?:(?:\.|{DOT})[\w-]+)+")
#: The sign of an address, and what no address holds.
SIGN, STRANGE = re.compile(rf"@|{AT}"), re.compile(r"[^\w.%+@()\[\]\x20-]|\x20\x20")
DAY = re.compile(r"[0-9]{4}[-.][0-9]{2}[-.][0-9]{2}|[0-9]{1,2}[-.][0-9]{1,2}[-.][0-9]{4}")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(value: str) -> str:
    return "".join(c for c in value if "0" <= c <= "9")


def valid(kind: str, value: str) -> bool:
    """Whether a matched value counts as its kind."""
    if kind == "ip":
        return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in value.split("."))
    digits = _digits(value)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return True


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local@domain: the local part is the run before the sign, after the last match."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of every pattern, by kind and start."""
    spans = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for k, pattern in ((1, IP), (2, CARD), (3, PHONE)):
            if k == 3 and "+" not in text:
                continue
            spans += [(k, *m.span()) for m in pattern.finditer(text) if valid(KINDS[k], m[0])]
    return spans


def plausible(kind: int, value: str) -> bool:
    """Checks on what the tagger adds: whole values of a kind that can be verified."""
    if value != value.strip():
        return False
    if kind == 0:
        return bool(ADDRESS.fullmatch(value))
    if kind == 1 and ":" in value:
        try:
            return value.count(":") > 2 and ipaddress.ip_address(value).version == 6
        except ValueError:
            return False
    if kind == 1:
        return bool(IP.fullmatch(value)) and valid("ip", value)
    if kind == 2:
        return bool(CARD.fullmatch(value)) and valid("card", value)
    marks = sum(value.count(c) for c in " ().-")
    shape = re.fullmatch(r"\+?\(?[0-9]+(?:[\x20().-]{1,2}[0-9]+)*", value)
    return bool(shape) and valid("phone", value) and not DAY.match(value) and (marks >= 2 or value[0] == "+")


def hopeless(kind: int, part: str) -> bool:
    """Whether no plausible value of the kind can hold this part of it, so that its ends need not be found."""
    if kind == 0:
        return len(SIGN.findall(part)) > 1 or bool(STRANGE.search(part))
    if kind == 1:
        return part.count(":") > 7 or (":" not in part and part.count(".") > 3) or any(c.isspace() for c in part)
    return len(_digits(part)) > (19 if kind == 2 else 15)


def shapes(text: str) -> list[tuple[int, int, int]]:
    """The base spans, and what has a card's shape: the tagger learns shapes, sums are checked afterwards."""
    cards = [(2, *m.span()) for m in CARD.finditer(text) if 13 <= len(_digits(m[0])) <= 19]
    return [s for s in base_spans(text) if s[0] != 2] + cards


def windows(text: str, known: list[tuple[int, int, int]] = ()) -> list[int]:
    """Starts of the windows that hold a trigger outside the known spans."""
    starts: set[int] = set()
    spans, i = sorted((a, b) for _, a, b in known), 0
    end = -1  # of the spans that begin before the trigger
    for m in TRIGGER.finditer(text):
        while i < len(spans) and spans[i][0] <= m.start():
            end = max(end, spans[i][1])
            i += 1
        if m.start() >= end:
            k = m.start() // STEP
            starts |= {k * STEP, (k - 1) * STEP}
    return sorted(starts)


def window_symbols(text: str, starts: list[int], width: int = WINDOW) -> np.ndarray:
    out = np.full((len(starts), width), EDGE, np.int64)
    for row, s in zip(out, starts, strict=True):
        piece = text[max(0, s) : max(0, s + width)]
        at = max(0, -s)
        row[at : at + len(piece)] = symbols(piece)
    return out


def reconcile(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """Of (start, end, kind, weight) spans, those without overlap of the highest total weight."""
    spans = sorted(set(spans), key=lambda s: (s[1], s[0], s[2]))
    ends = [s[1] for s in spans]
    best, chosen = [0.0], []
    for i, (start, _, _, weight) in enumerate(spans):
        before = int(np.searchsorted(ends[:i], start, "right"))
        chosen.append((best[before] + weight > best[-1], before))
        best.append(max(best[-1], best[before] + weight))
    out, i = [], len(spans)
    while i:
        take, before = chosen[i - 1]
        if take:
            out.append((spans[i - 1][2], spans[i - 1][0], spans[i - 1][1]))
        i = before if take else i - 1
    return out[::-1]


def tagged_spans(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the begin and inside runs of one window."""
    out, start, kind = [], -1, 0
    for i, tag in enumerate([*tags.tolist(), 0]):
        if start >= 0 and (tag == 0 or tag % 2 == 1):
            out.append((start, i, kind))
            start = -1
        if tag % 2 == 1:
            start, kind = i, tag // 2
    return out


def added_spans(texts: list[str], base: list[list[tuple[int, int, int]]], model: Tagger) -> list[list[tuple[int, int, int]]]:
    """What the tagger finds beyond the base spans, per text."""
    todo = {(i, s) for i, (text, own) in enumerate(zip(texts, base, strict=True)) for s in windows(text, own)}
    found: list[list] = [[] for _ in texts]
    width = WINDOW
    while todo:
        where, todo = sorted(todo), set()
        batch = max(1, 512 * WINDOW // width)
        for at in range(0, len(where), batch):
            part = where[at : at + batch]
            x = np.concatenate([window_symbols(texts[i], [s], width) for i, s in part])
            e = model.emissions(x)
            tags = model.decode(e)
            hit = np.nonzero(tags.any(axis=1))[0]
            if not len(hit):
                continue
            probability = model.marginals(e[:, hit])
            for n, row in enumerate(hit.tolist()):
                i, s = part[row]
                for start, end, kind in tagged_spans(tags[row]):
                    if (start == 0 and s > 0) or (end == width and s + width < len(texts[i])):
                        # Cut by the edge: it is in the middle of a window twice as wide.
                        if not hopeless(kind, texts[i][max(0, s + start) : s + end]):
                            todo.add((i, (s + (start + end) // 2 - width // 2) // width * width))
                        continue
                    sure = float(probability[np.arange(start, end), n, tags[row, start:end]].mean())
                    if sure >= CONFIDENCE:
                        found[i].append((s + start, s + end, kind, sure * (end - start)))
        width *= 2
    out = []
    for text, own, spans in zip(texts, base, found, strict=True):
        good = [x for x in spans if plausible(x[2], text[x[0] : x[1]]) and all(x[1] <= a or b <= x[0] for _, a, b in own)]
        out.append(reconcile(good))
    return out


def _number(rng: random.Random) -> str:
    """A number that is no personal data."""
    n = rng.randrange
    return rng.choice(
        [str(n(1, 10)), str(n(10, 10_000)), f"{n(1900, 2100)}", f"{n(1900, 2100)}-{n(1, 13):02d}-{n(1, 32):02d}", f"{n(1, 32)}.{n(1, 13)}.{n(1990, 2030)}", f"{n(24)}:{n(60):02d}"]
        + [f"{n(10)}.{n(20)}.{n(20)}", f"{n(100)}.{n(100):02d}", f"{n(1, 100)},{n(1000):03d},{n(1000):03d}", f"{n(10**5, 10**8)}", f"#{n(1000)}", f"{n(100, 1000)}-{n(10, 100)}", f"{n(16**12):012x}"]
    )


def _digits_of(rng: random.Random, n: int) -> str:
    return "".join(rng.choices("0123456789", k=n))


def _name(rng: random.Random) -> str:
    """An invented name of a person, firm or host, so that shapes are learnt and not the table's few names."""
    return "".join(rng.choice("bcdfghjklmnprstvwz") + rng.choice(["a", "e", "i", "o", "u", "an", "er", "in", "ch", "st"]) for _ in range(rng.randint(1, 4)))


def _address(rng: random.Random) -> str:
    local = rng.choice(["", "", _name(rng)[0] + rng.choice("._"), _name(rng) + rng.choice(".-_+")]) + _name(rng) + rng.choice(["", "", str(rng.randrange(2000))])
    host = rng.choice(["", _name(rng) + "-", _name(rng) + "."]) + _name(rng)
    return f"{local}@{host}.{''.join(rng.choices('abcdefghijklmnopqrstuvwxyz', k=rng.choice((2, 2, 3, 3, 4))))}"


def _written(kind: int, value: str, rng: random.Random) -> str:
    """A value in one of the ways in which people write it."""
    if kind == 0 and rng.random() < 0.8:
        local, _, domain = (value if rng.random() < 0.2 else _address(rng)).partition("@")
        if rng.random() < 0.4:
            at = rng.randrange(len(local))
            return local[:at] + rng.choice("éüñäöçßø") + local[at + 1 :] + "@" + domain
        at, dot = rng.choice([(" (at) ", "."), ("(at)", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", ".")])
        return local + at + domain.replace(".", dot)
    if kind == 1 and rng.random() < 0.4:
        groups = [f"{rng.randrange(1 << rng.choice((8, 16))):x}" for _ in range(8)]
        if rng.random() < 0.5:
            at = rng.randrange(1, 5)
            return ":".join(groups[:at]) + "::" + ":".join(groups[at + 2 :])
        return ":".join(groups)
    if kind == 2 and rng.random() < 0.8:
        digits, sep = _digits_of(rng, rng.choice((13, 14, 15, 16, 16, 16, 16, 19))), rng.choice(["", "", " ", "-"])
        return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    if kind == 3 and rng.random() < 0.7:
        a, b, c = _digits_of(rng, 3), _digits_of(rng, 3), _digits_of(rng, 4)
        d, e = _digits_of(rng, 2), _digits_of(rng, rng.randint(6, 8))
        return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}", f"00{d} {a} {e}", f"0{a} {b} {c}", f"+{d} {a} {e}", f"0{d}-{e[:4]}-{c}"])
    return value


def variants(text: str, spans: list[tuple[int, int, int]], values: list[tuple[int, str]], rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A window's text with its values rewritten, some of them beside other numbers, and the spans in it.

    A window without spans gets numbers that are no values.
    """
    pieces, at, out, size = [], 0, [], 0

    def put(piece: str, kind: int | None = None) -> None:
        nonlocal size
        if kind is not None:
            out.append((kind, size, size + len(piece)))
        pieces.append(piece)
        size += len(piece)

    if not spans:
        for i, word in enumerate(text.split(" ")):
            put((" " if i else "") + (_number(rng) + " " if rng.random() < 0.15 else "") + word)
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if a < at:
            continue
        put(text[at:a])
        beside = rng.random()
        if beside < 0.15:
            put(_number(rng) + " ")
        put(_written(kind, text[a:b], rng), kind)
        if beside > 0.8 and values:  # another value stands right beside it
            other, value = rng.choice(values)
            put(" ")
            put(_written(other, value, rng), other)
        elif beside > 0.5:
            put(rng.choice(" -") + _number(rng))
        at = b
    if spans:
        put(text[at:])
    return "".join(pieces), out


def labelled_windows(docs: DataFrame, text_col: str, most: int = SAMPLE_WINDOWS // 2) -> DataFrame:
    """Windows with the spans in them: text, spans (kind:start:end, comma-joined), h.

    A task passes on its distinct windows of least hash, ``most`` with spans and as
    many without; those of least hash of the whole table are among them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        kept: tuple[dict, dict] = {}, {}
        heaps: tuple[list, list] = [], []
        for batch in batches:
            for value in batch.column("text"):
                text = value.as_py()
                spans = shapes(text)
                for s in windows(text):
                    a, b = max(0, s), s + WINDOW
                    if any(x < a < y or x < b < y for _, x, y in spans):
                        continue
                    inside = ",".join(f"{k}:{x - a}:{y - a}" for k, x, y in spans if a <= x and y <= b)
                    own, heap = kept[bool(inside)], heaps[bool(inside)]
                    h = xxhash.xxh64_intdigest(text[a:b].encode("utf-8", "surrogatepass"), SEED) >> 1
                    if h in own or (len(heap) == most and h >= -heap[0]):
                        continue
                    own[h] = text[a:b], inside
                    if len(heap) == most:
                        del own[-heapq.heappushpop(heap, -h)]
                    else:
                        heapq.heappush(heap, -h)
        rows = [(t, m, h) for own in kept for h, (t, m) in own.items()]
        yield pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows], k) for i, (c, k) in enumerate((("text", pa.string()), ("spans", pa.string()), ("h", pa.int64())))})

    held = docs.select(F.col(text_col).alias("text")).filter(F.col("text").rlike(r"[0-9@]|[(\[]at[)\]]"))
    return held.mapInArrow(run, "text string, spans string, h long")


def train(docs: DataFrame, text_col: str = "text", sample_windows: int = SAMPLE_WINDOWS, steps: int = TRAIN_STEPS) -> Tagger | None:
    """Fit the tagger on at most ``sample_windows`` distinct windows, half of them with spans, half without."""
    half = sample_windows // 2
    found = labelled_windows(docs, text_col, half).groupBy("h").agg(F.min(F.struct("text", "spans")).alias("w")).select("h", "w.*")
    rows = [tuple(r) for r in found.filter("spans <> ''").orderBy("h").limit(half).unionByName(found.filter("spans = ''").orderBy("h").limit(half)).select("text", "spans").collect()]
    return fitted([(text, [tuple(map(int, m.split(":"))) for m in marks.split(",") if m]) for text, marks in sorted(rows)], steps)


def fitted(labelled: list[tuple[str, list[tuple[int, int, int]]]], steps: int = TRAIN_STEPS) -> Tagger | None:
    """The tagger of labelled windows (text, spans) and of rewritten ones; None without any span."""
    values = [(k, text[a:b]) for text, spans in labelled for k, a, b in spans]
    if not values:
        return None
    rng, x, y = random.Random(SEED), [], []
    marked = sum(bool(spans) for _, spans in labelled)
    for text, spans in labelled:
        # The windows of a small table are rewritten more often: the examples are as many.
        share = marked if spans else len(labelled) - marked
        again = -(-(REWRITTEN if spans else REWRITTEN // 3) // share)
        for new_text, new_spans in [(text, spans), *(variants(text, spans, values, rng) for _ in range(again))]:
            shift = rng.randrange(-STEP // 2, STEP // 2)
            x.append(window_symbols(new_text, [shift])[0])
            tags = np.zeros(WINDOW, np.int64)
            for kind, a, b in new_spans:
                a, b = a - shift, b - shift
                if a >= 0 and b <= WINDOW:
                    tags[a], tags[a + 1 : b] = 2 * kind + 1, 2 * kind + 2
                else:  # cut by the edge: show the tagger none of it
                    x[-1][max(0, a) : max(0, b)] = EDGE
            y.append(tags)
    model = Tagger.fresh(len(KINDS), HIDDEN, SEED)
    model.fit(np.array(x), np.array(y), epochs=max(1, round(steps * BATCH / len(x))), batch=BATCH, rate=RATE, seed=SEED)
    return model


def _search(docs: DataFrame, text_col: str, model: Tagger | None) -> DataFrame:
    """Every row as keep (other columns), text, base and added: arrays of (kind, start, end)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rest = [F.col(c) for c in docs.columns if c != text_col] or [F.lit(True).alias("row")]
    rows = docs.select(F.struct(*rest).alias("keep"), F.col(text_col).alias("text"))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def as_array(spans: list) -> pa.Array:
        return pa.array([[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in x] for x in spans], span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                texts = [t or "" for t in piece.column("text").to_pylist()]
                base = [base_spans(t) for t in texts]
                added = added_spans(texts, base, sent.value) if sent.value else [[] for _ in texts]
                yield pa.RecordBatch.from_arrays([*piece.columns, as_array(base), as_array(added)], ["keep", "text", "base", "added"])

    kind = rows.schema["keep"].dataType.simpleString()
    spans = "array<struct<kind: string, start: long, end: long>>"
    return rows.mapInArrow(run, f"keep {kind}, text string, base {spans}, added {spans}")


def _ordered(column: str):
    """Spans sorted by kind as listed, then start."""
    kinds = F.array(*map(F.lit, KINDS))

    def keyed(s):
        return F.struct(F.array_position(kinds, s["kind"]).alias("k"), *[s[c].alias(c) for c in ("start", "end", "kind")])

    return F.array_sort(F.transform(column, keyed))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Tagger | None = None) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans."""
    model = model or train(docs, text_col)
    found = _search(docs.select(id_col, text_col), text_col, model)

    def said(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def times(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    found = found.withColumn("all", F.concat("base", "added"))
    return found.select(
        F.col("keep")[id_col].alias("doc_id"),
        *[times(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(said(_ordered("base")), 256).alias("base_sha256"),
        said(_ordered("all")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        F.size("all").cast("long").alias("n_spans"),
    )


def redacted(docs: DataFrame, text_col: str = "text", model: Tagger | None = None) -> DataFrame:
    """The documents with every span of personal data replaced by its kind in angle brackets."""
    found = _search(docs, text_col, model or train(docs, text_col)).withColumn("all", F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc, s):
        gap = F.substr(F.col("text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        fresh = s["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], gap, F.lit("<"), s["kind"], F.lit(">"))).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    text = F.aggregate("all", start, step, lambda acc: F.concat(acc["out"], F.substr(F.col("text"), acc["at"] + 1)))
    clean = F.when(F.size("all") > 0, text).otherwise(F.col("text"))
    return found.select(*[clean.alias(c) if c == text_col else F.col("keep")[c].alias(c) for c in docs.columns])
