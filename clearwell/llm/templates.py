"""Benchmark decontamination by template windows, with DataFrame functions only.

A text becomes a row of words in which numbers, names and units are typed
placeholders, so a question whose figures or names were exchanged keeps its
template. Windows of template words are hash-joined with those of the
benchmark; what fills the slots must then be exchanged consistently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import MOST_IDS, written

WINDOW = 5
#: Share of an item's template windows that a document must hold.
SHARE = 0.8
#: Share of slots whose filling follows one exchange: each value of the item always becomes the same value.
CONSISTENT = 0.8
#: Placeholder-only templates say nothing: a window of fewer plain words counts only with the same words in its slots.
PLAIN = 2
#: Items of fewer words are left out, unless a caller asks for them.
SHORTEST = 3
UNITS = "km|cm|mm|m|kg|g|mg|lb|lbs|oz|l|ml|s|sec|seconds?|min|minutes?|h|hours?|days?|weeks?|months?|years?|miles?|feet|ft|inch|inches|dollars?|euros?|cents?|usd|eur|percent|degrees?"
#: A benchmark of up to so many windows is broadcast; a larger one is joined by shuffle.
MOST_BROADCAST = 500_000


def spaced(text: Column) -> Column:
    """The words (runs of letters and digits) of a text, a space before and after each."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def template(words: Column, names: bool = True) -> Column:
    """The spaced words with placeholders in place of numbers, units after numbers and capitalised words; one word stays one."""
    if names:
        words = F.regexp_replace(words, r" \p{Lu}\p{Ll}+(?= )", " @name")
    numbers = F.when(words.rlike(r" \p{N}"), F.regexp_replace(words, r" \p{N}+(?= )", " @number")).otherwise(words)
    units = F.when(numbers.contains("@number"), F.regexp_replace(numbers, rf"(?<= @number) (?i:{UNITS})(?= )", " @unit")).otherwise(numbers)
    return F.lower(units)


def windows(words: Column, size: int = WINDOW) -> Column:
    """All runs of ``size`` words as strings, in order."""
    ahead = " ".join([r"\S+"] * size)
    return F.regexp_extract_all(words, F.lit(rf" (?=({ahead}) )"), F.lit(1))


def _split(spaced_words: Column) -> Column:
    return F.split(F.trim(spaced_words), " ")


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """A row for each distinct template window of each item: where it stands first, its slots, and how many the item has.

    An item is filed in two forms, with its names as placeholders and with its
    names as words (``worded``), as a text in one case throughout shows no
    names. Windows of fewer than ``PLAIN`` plain words are left out of the first
    form and ``exact`` in the second: filed by their words, without slots.
    Items of fewer words than a window have no row; see ``short_items``.
    """
    words = spaced(F.col("text"))
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    forms = F.array(*[F.struct(F.lit(i).alias("form"), windows(template(words, names)).alias("windows")) for i, names in enumerate((True, False))])
    df = items.select("item_id", _split(words).alias("words"), F.explode(forms).alias("f")).select("item_id", "words", "f.form", F.posexplode("f.windows").alias("item_pos", "window"))
    parts = F.split("window", " ")
    df = df.withColumn("exact", F.size(F.filter(parts, lambda w: ~w.startswith("@"))) < PLAIN).where("form = 1 OR NOT exact")
    slots = F.filter(
        F.transform(parts, lambda w, i: F.struct(i.alias("offset"), w.alias("kind"), F.element_at("words", F.col("item_pos") + i + 1).alias("value"))),
        lambda s: s["kind"].startswith("@") & ~F.col("exact"),
    )
    said = F.lower(F.array_join(F.slice("words", F.col("item_pos") + 1, WINDOW), " "))
    df = df.select("item_id", "form", "item_pos", "exact", F.when(F.col("exact"), said).otherwise(F.col("window")).alias("window"), slots.alias("slots"))
    df = df.groupBy("item_id", "form", "window", "exact").agg(F.min_by(F.struct("item_pos", "slots"), "item_pos").alias("at"))
    number = lambda rule: F.nullif(F.count_if(F.expr(rule)), F.lit(0))
    sizes = df.groupBy("item_id").agg(F.least(number("form = 0"), number("form = 1 AND NOT exact")).alias("n_windows"), number("form = 1").alias("n_worded"))
    filed = df.groupBy("item_id", "window").agg(F.min_by("at", "form").alias("at"), (F.max("form") == 1).alias("worded"))
    return filed.select("item_id", "window", "worded", "at.*").join(sizes, "item_id")


def short_items(benchmark: DataFrame, shortest: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id``, ``words`` (in lower case) and their number, of the items of ``shortest`` words and more that are shorter than a window."""
    words = F.lower(F.trim(spaced(F.col(text_col).cast("string"))))
    df = benchmark.select(F.col(id_col).cast("long").alias("item_id"), words.alias("words")).where("words != ''")
    return df.withColumn("n", F.size(F.split("words", " "))).where(F.col("n").between(shortest, WINDOW - 1))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """Pairs of a document and an item it holds: ``doc_id``, ``item_id``, ``share``, ``consistency``, ``kind``, ``of``.

    ``kind`` is ``verbatim`` where every slot is filled as in the item and
    ``reparameterised`` where the fillings are exchanged consistently; pairs
    whose fillings follow no exchange are dropped. ``of`` is the hash of the
    document's text (:func:`text_hash`): rows that share an id, or have none,
    are documents of their own where their texts differ.
    A document is looked up with its names as placeholders and as words, so
    that a copy with every word capitalised is found. Items shorter than a
    window, of ``shortest`` words and more, are found by their words alone.
    """
    items = written(item_windows(benchmark), "items")
    if items.count() <= MOST_BROADCAST:
        items = F.broadcast(items)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    source = source.select("doc_id", text_hash(F.col("text")).alias("of"), spaced(F.col("text")).alias("spaced"))
    forms = source.select("doc_id", "of", "spaced", template(F.col("spaced")).alias("named"), template(F.col("spaced"), False).alias("worded"))
    said = F.when(F.col("worded").rlike(r"@\S+ @\S+"), windows(F.lower("spaced"))).otherwise(F.array().cast("array<string>"))  # else no window is exact
    looked = forms.select("doc_id", "of", "spaced", windows(F.col("named")).alias("named"), windows(F.col("worded")).alias("worded"), said.alias("said"))
    exploded = looked.select("doc_id", "of", "spaced", F.size("named").alias("n"), F.posexplode(F.concat("named", "worded", "said")).alias("at", "window"))
    found = exploded.join(items, "window").withColumns({"pos": (F.col("at") % F.col("n")).cast("int"), "form": F.when(F.col("at") < F.col("n"), 0).otherwise(1)})
    words = _split(F.col("spaced"))
    filled = F.transform("slots", lambda s: F.struct(s["kind"].alias("kind"), F.lower(s["value"]).alias("old"), F.lower(F.element_at(words, F.col("pos") + s["offset"] + 1)).alias("new")))
    hit = ["item_id", "item_pos", "n_windows", "n_worded", "worded", "form", (F.col("pos") - F.col("item_pos")).alias("shift"), "of"]
    hits = written(found.select("doc_id", *hit, filled.alias("filled")), "hits")
    share = lambda held, n: F.sum(held) / F.first(n)
    shares = (
        hits.groupBy("doc_id", "of", "item_id", "item_pos")
        .agg(*[F.first(n).alias(n) for n in ("n_windows", "n_worded")], F.max(F.expr("int(form = 0)")).alias("named"), F.max(F.expr("int(form = 1 AND worded)")).alias("worded"))
        .groupBy("doc_id", "of", "item_id").agg(F.least(F.greatest(share("named", "n_windows"), share("worded", "n_worded")), F.lit(1.0)).alias("share"))
    )
    once = hits.groupBy("doc_id", "of", "item_id", "item_pos", "shift").agg(F.min_by("filled", "form").alias("filled"))
    slots = once.select("doc_id", "of", "item_id", "shift", F.explode("filled").alias("slot")).select("doc_id", "of", "item_id", "shift", "slot.*")
    ways = slots.groupBy("doc_id", "of", "item_id", "shift", "kind", "old", "new").agg(F.count("*").alias("n"))
    usual = ways.groupBy("doc_id", "of", "item_id", "shift", "kind", "old").agg(
        F.sum("n").alias("n"), F.max("n").alias("agreed"), F.sum(F.when(F.col("old") == F.col("new"), F.col("n")).otherwise(0)).alias("same")
    )
    kept = usual.groupBy("doc_id", "of", "item_id").agg((F.sum("agreed") / F.sum("n")).alias("consistency"), (F.sum("same") / F.sum("n")).alias("same"))
    both = shares["doc_id"].eqNullSafe(kept["doc_id"]) & (shares["of"] == kept["of"]) & (shares["item_id"] == kept["item_id"])
    pairs = shares.join(kept, both, "left").select(shares["doc_id"], shares["item_id"], shares["of"], "share", F.coalesce("consistency", F.lit(1.0)).alias("consistency"), F.coalesce("same", F.lit(1.0)).alias("same"))
    kind = F.when(F.col("same") >= 1.0, "verbatim").otherwise("reparameterised")
    pairs = pairs.where((F.col("share") >= SHARE) & (F.col("consistency") >= CONSISTENT)).select("doc_id", "item_id", "share", "consistency", kind.alias("kind"), "of")
    short = written(short_items(benchmark, shortest), "short")
    for n in [r["n"] for r in short.select("n").distinct().collect()]:
        runs = source.select("doc_id", "of", F.explode(F.array_distinct(windows(F.lower("spaced"), n))).alias("words"))
        held = runs.join(short.where(F.col("n") == n), "words").select("doc_id", "of", "item_id").distinct()
        pairs = pairs.union(held.select("doc_id", "item_id", F.lit(1.0), F.lit(1.0), F.lit("verbatim"), "of"))
    return pairs


def text_hash(text: Column) -> Column:
    """Tells the texts of rows that share an id apart."""
    return F.xxhash64(text)


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns.

    Leaking rows are written and counted; up to ``MOST_IDS`` of them are
    broadcast, so that texts are not shuffled, more are joined by shuffle.
    """
    gone = written(leaks(docs, benchmark, id_col, text_col, shortest).select(F.col("doc_id").alias("__id"), F.col("of").alias("__of")).distinct(), "leaked")
    here = F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (text_hash(F.col(f"`{text_col}`").cast("string")) == F.col("__of"))
    return docs.join(F.broadcast(gone) if gone.count() <= MOST_IDS else gone, here, "left_anti")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """Per row: ``doc_id``, ``contaminated``, ``n_items``, ``item_ids`` (ascending), ``n_reparameterised``.

    Null and empty texts, and an empty benchmark, contaminate nothing; repeated
    rows each get their row, and rows that share an id or have none are judged
    by their own texts; extra columns are ignored.
    """
    found = leaks(docs, benchmark, id_col, text_col, shortest).groupBy("doc_id", "of").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.sum((F.col("kind") == "reparameterised").cast("long")).alias("n_reparameterised")
    ).withColumnsRenamed({"doc_id": "found_id", "of": "found_of"})
    ids = docs.select(F.col(id_col).alias("doc_id"), text_hash(F.col(text_col).cast("string")).alias("of"))
    same = F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("of") == F.col("found_of"))
    return ids.join(found, same, "left").select(
        "doc_id",
        F.col("item_ids").isNotNull().alias("contaminated"),
        F.when(F.col("item_ids").isNull(), 0).otherwise(F.size("item_ids")).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"),
        F.coalesce("n_reparameterised", F.lit(0)).cast("long").alias("n_reparameterised"),
    )
