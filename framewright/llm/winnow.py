"""Document fingerprints by winnowing, in DataFrame functions only.

Every run of GRAM bytes has a rolling hash, a cyclic polynomial of its words of WORD
bytes: the exclusive or of the words' own hashes, each turned left by one bit more
than the next one's. So a hash goes on by a word when it is turned by a bit, the
word that leaves is taken out and the next one put in; the runs from each of WORD
neighbouring bytes roll side by side. Columns have no running state, so each hash is
put together from its few words, whose hashes are made once, with the value that
rolling gives. Of each WINDOW hashes
in a row the least is chosen, the rightmost of equal ones; what is chosen is kept
with its position. So any run of GRAM + WINDOW - 1 equal bytes in two texts gives
them a common print. Texts are cut into overlapping pieces first, so that a row's
memory doesn't grow with its text.
"""

from __future__ import annotations

import functools
from collections import Counter

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import text_of

GRAM, WORD, WINDOW = 16, 8, 32
#: Windows of one piece, and windows looked at together (fewer than WINDOW).
PIECE, STEP = 4096, 4
LEAST = -(1 << 63)
#: Ranges that documents are dealt to, at most; their bounds are part of the plan.
RANGES = 10_000


def _turned(h: Column, bits: int) -> Column:
    return F.shiftleft(h, bits % 64).bitwiseOR(F.shiftrightunsigned(h, 64 - bits % 64)) if bits % 64 else h


def rolling(data: Column, gram: int, word: int = WORD) -> Column:
    """The rolling hashes of all runs of gram bytes, a multiple of word, of a binary column; of shorter data one, as if void bytes followed."""
    if gram % word:
        raise ValueError("a gram is a number of whole words")
    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  as a lambda's variable, a value is not made anew for each place
    places = lambda count, f: F.transform(F.sequence(F.lit(0), count - 1), f)
    size, n = F.greatest(F.octet_length(data), F.lit(gram)), gram // word
    words = once(data, lambda b: places(size - (word - 1), lambda i: F.xxhash64(F.substring(b, i + 1, F.lit(word)))))
    turned = lambda w, i: [_turned(F.get(w, i + word * k), n - 1 - k) for k in range(n)]
    # The words are all there; that a hash is never null keeps the generated code, which reads many of them, small.
    return once(words, lambda w: places(F.size(w) - (gram - word), lambda i: F.coalesce(functools.reduce(Column.bitwiseXOR, turned(w, i)), F.lit(0).cast("long"))))


def chosen(rows: DataFrame, keys: list[str], texts: list[str], carried: list[str] = (), gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """One row for each keys: `<text>_prints`, an array of (pos, hash) by position, for each of the text columns, and the carried columns.

    keys must tell all rows apart. Positions are bytes from 0. Null and empty texts
    have one print, that of no bytes; so have texts shorter than a gram, of all
    their bytes. No shuffle is added where rows are already dealt by some of the keys.
    """
    data = F.array(*(F.coalesce(F.col(t), F.lit("")).cast("binary") for t in texts))
    windows = lambda size: F.greatest(size - (gram + window - 2), F.lit(1))
    places = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(len(texts) - 1)), lambda t: F.transform(
        F.sequence(F.lit(0), windows(F.octet_length(F.get("_data", t))) - 1, F.lit(PIECE)), lambda s: F.struct(t.alias("text"), s.alias("start")))))
    head = (F.col("_at.text") == 0) & (F.col("_at.start") == 0)
    pieces = (
        rows.select(*keys, F.struct(F.lit(1).alias("_"), *carried).alias("_c"), data.alias("_data")).select("*", F.explode(places).alias("_at"))
        .select(*keys, F.when(head, F.col("_c")).alias("_c"), "_at", F.substring(F.get("_data", F.col("_at.text")), F.col("_at.start") + 1, F.lit(PIECE + gram + window - 2)).alias("_bytes"))
    )
    hashed = pieces.select(*keys, "_c", "_at", rolling(F.col("_bytes"), gram).alias("_h"))
    # STEP windows at a time. Where the least hash that all of them and the window before hold is below all others,
    # they choose what that one chose; only the other windows are looked at one by one. Plain least() over places
    # stays in generated code.
    i, ends = F.col("i"), F.greatest(F.size("_h") - window, F.lit(0))
    at = lambda j: F.get("_h", i + j)
    left = lambda j: F.coalesce(at(j), F.lit(LEAST))  # noqa: E731  none: it counts as chosen before
    shared = F.coalesce(F.least(*map(at, range(STEP - 1, window - 1))), F.lit(-LEAST - 1))
    edges = F.least(left(-1), *map(at, range(STEP - 1)), *map(at, range(window - 1, window + STEP - 1)))
    some = hashed.select("*", F.explode(F.sequence(F.lit(0), ends, F.lit(STEP))).alias("i")).where(shared >= edges)
    found = []
    for j in range(STEP):
        # The rightmost of equal ones is chosen: what leaves must be below the rest, what enters need not be above.
        inner = F.least("_s", *map(at, range(j, STEP - 1)), *map(at, range(window - 1, window + j - 1)))
        enters = at(j + window - 1)
        found.append(F.when((inner >= F.least(left(j - 1), enters)) & (i + j <= ends), F.struct((i + j).alias("at"), F.least(inner, enters).alias("hash"))))
    some = some.select("*", shared.alias("_s")).select(*keys, F.when(i == 0, F.col("_c")).alias("_c"), "_at", "_h", F.explode(F.array(*found)).alias("w")).where("w IS NOT NULL")
    prints = some.select(*keys, "_c", "_at", "w", F.slice("_h", F.col("w.at") + 1, window).alias("_w"))
    pos = F.col("_at.start") + F.col("w.at") + F.size("_w") - F.array_position(F.reverse("_w"), F.col("w.hash"))
    prints = prints.select(*keys, "_c", F.col("_at.text").alias("text"), F.struct(pos.alias("pos"), F.col("w.hash").alias("hash")).alias("p"))
    # Pieces overlap by a window, so the same print may come twice; by position, equal ones stand together.
    once = lambda a: F.filter(a, lambda p, n: (n == 0) | (p["pos"] != F.get(a, n - 1)["pos"]))
    lists = [F.get(F.transform(F.array(F.sort_array(F.collect_list(F.when(F.col("text") == n, F.col("p"))))), once), F.lit(0)).alias(f"{t}_prints") for n, t in enumerate(texts)]
    out = prints.groupBy(*keys).agg(*lists, F.first("_c", ignorenulls=True).alias("_c"))
    return out.select(*keys, *(f"{t}_prints" for t in texts), *(F.col(f"_c.{c}").alias(c) for c in carried))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two fingerprints' hashes."""
    a, b = (F.array_distinct(F.transform(x, lambda p: p["hash"])) for x in (a, b))
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def as_text(prints: Column) -> Column:
    """hash:position in hexadecimal, by position."""
    return F.array_join(F.transform(prints, lambda p: F.concat_ws(":", F.hex(p["hash"]), F.hex(p["pos"]))), " ")


def _beginning(text: Column) -> Column:
    """A text's first 6 bytes as a number, which rises with the text."""
    return F.conv(F.rpad(F.hex(F.substring(text.cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("long")


def _ranges(rows: DataFrame) -> tuple[list[tuple[int, int]], tuple[int, int] | None]:
    """Bounds that cut rows into ranges of like numbers, each the least (_key, _sub) of its range; and the least of all.

    Keys on which several quantiles fall, as they do where many rows share a doc_id
    or have none, are cut by quantiles of _sub as well. Quantiles are rounded; the
    bounds are what the rows that they part really begin with.
    """
    wanted = min(RANGES, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    count = rows.count()
    n = max(2, min(count, wanted))
    parts, fine = [i / n for i in range(1, n)], 10_000 + 20 * n
    found = Counter(rows.agg(F.percentile_approx("_key", parts, fine)).first()[0] or [])
    hot = {k: times for k, times in found.items() if times > 1}
    about = [(k, LEAST) for k in found]
    if hot:
        for r in rows.where(F.col("_key").isin(*hot)).groupBy("_key").agg(F.percentile_approx("_sub", parts, fine).alias("at")).collect():
            about += [(r["_key"], r["at"][i * (n - 1) // hot[r["_key"]]]) for i in range(hot[r["_key"]])]  # as many as quantiles fell on the key
    begins = rows.groupBy(_range_of(_own_place(), sorted(set(about))).alias("range")).agg(F.min(_own_place()).alias("at")).collect()
    bounds = sorted((r["at"]["key"], r["at"]["sub"]) for r in begins)
    return bounds[1:], bounds[0] if bounds else None


def _own_place() -> Column:
    return F.struct(F.col("_key").alias("key"), F.col("_sub").alias("sub"))


def _written(places: list[tuple[int, int]]) -> str:
    """Places as SQL, which many thousands of literals are parsed from at once."""
    return ", ".join(f"named_struct('key', {k}L, 'sub', {s}L)" for k, s in places)


def _range_of(place: Column, bounds: list[tuple[int, int]]) -> Column:
    """How many bounds are not above place, found in two steps of about the root of their number."""
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    upto = lambda xs: F.size(F.filter(xs, lambda b: b <= place))
    coarse = upto(F.expr(f"array({_written([g[0] for g in groups])})"))
    fine = F.expr(f"array({', '.join(f'array({_written(g)})' for g in groups)})")
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * width + upto(F.get(fine, coarse - 1)))


def _is_one_of(places: list[tuple[int, int]]) -> Column:
    return F.expr(f"named_struct('key', _key, 'sub', _sub) IN ({_written(places)})") if places else F.lit(False)


def with_neighbours(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, edited_sha256, prints, edited_prints, near_edited, near_next for every row of docs.

    The next document is the one with the next larger doc_id, after the last the
    first. Rows without doc_id come before all others; rows that share one stand by
    their text. A row alone is its own next. An empty table gives an empty table.

    Texts are dealt once, by ranges of doc_id; each range also gets the first row
    of the next, so that no row's neighbour is elsewhere. Where many rows share a
    doc_id or have none, ranges go by the beginning of the text as well; a range
    holds all rows that are alike in both.
    """
    rows = docs.select("doc_id", F.coalesce(docs["doc_id"].cast("long"), F.lit(LEAST)).alias("_key"), text_of(docs).alias("text"))
    rows = rows.withColumn("_sub", _beginning(F.col("text")))
    bounds, first = _ranges(rows)
    own = F.col("_own")
    guest = lambda where, at: F.when(where, F.array(F.struct(at.alias("range"), F.lit(True).alias("guest")))).otherwise(F.array().cast("array<struct<range:int,guest:boolean>>"))
    places = F.concat(F.array(F.struct(own.alias("range"), F.lit(False).alias("guest"))), guest(_is_one_of(bounds), own - 1), guest(_is_one_of([first] if first else []), F.lit(len(bounds))))
    ranged = rows.withColumn("_own", _range_of(_own_place(), bounds))
    dealt = ranged.select("doc_id", "_key", "text", F.explode(places).alias("_p")).select("doc_id", "_key", "text", "_p.range", "_p.guest")
    order = Window.partitionBy("range").orderBy("guest", "_key", "text")
    half = F.floor(F.length("text") / 2).cast("int")
    rows = dealt.select("*", F.row_number().over(order).alias("at"), F.lead("text").over(order).alias("_next"))
    edited = F.when(F.col("guest"), F.lit("")).otherwise(F.concat(F.left("text", F.length("text") - half), F.left(F.coalesce("_next", "text"), half)))
    rows = rows.select("range", "at", "text", edited.alias("edited"), "doc_id", "guest", F.length("text").cast("long").alias("n_chars"))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    found = chosen(rows, ["range", "at"], ["text", "edited"], ["doc_id", "guest", "n_chars", "edited_sha256"], gram, window)
    found = found.withColumn("_next", F.lead("text_prints").over(Window.partitionBy("range").orderBy("at"))).where("NOT guest")
    return found.select(
        "doc_id", "n_chars", "edited_sha256", F.col("text_prints").alias("prints"), F.col("edited_prints"),
        likeness(F.col("text_prints"), F.col("edited_prints")).alias("near_edited"), likeness(F.col("text_prints"), F.coalesce("_next", "text_prints")).alias("near_next"),
    )
