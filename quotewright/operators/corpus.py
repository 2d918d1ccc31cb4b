"""The corpus as tables: upserts, derived columns, representations, statistics, fingerprints, gates and curation.

Gates return the offending rows; `require_empty` turns rows into an error. Null keys never match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotewright.functions.normalize import tiers
from quotewright.functions.text import full_text
from quotewright.operators.skew import running
from quotewright.runtime import written

#: Separators of the fingerprint, and the names of representations.
FIELD, ROW, NULL = "\x1f", "\x1e", "\x00"
PRIMARY, FULL = "primary", "full"
RECORD_COLUMNS = ["id", "source_id", "kind", "surah", "ayah", "collection", "hadith_no", "text_ar", "unscorable_reason", "norm_light", "norm_standard", "norm_aggressive"]


class GateError(Exception):
    """A gate found rows where there must be none."""


def require_empty(rows: DataFrame, what: str, shown: int = 5) -> None:
    """GateError with the first rows if there are any."""
    found = rows.take(shown)
    if found:
        raise GateError(f"{what}: {[r.asDict() for r in found]}")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows of both, of each key the last by `order`; a row of `new` beats one of `old`. Ties within `new` go to the
    largest by all columns, so that the result doesn't depend on partitions."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    latest = both.groupBy(*keys).agg(F.max(F.struct("_new", *order, *[c for c in rest if c not in order])).alias("_last"))
    return latest.select(*[F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in old.columns])


def latest_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the row that is last by `order`; one map-side aggregate, no sort of a hot key."""
    rest = [c for c in df.columns if c not in [*keys, *order]]
    last = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_last"))
    return last.select(*[F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in df.columns])


def derive(records: DataFrame) -> DataFrame:
    """records with the three tiers and the digest of text_ar worked out anew."""
    plain = records.drop("norm_light", "norm_standard", "norm_aggressive", "text_ar_sha256")
    return tiers(plain.withColumn("text_ar_sha256", F.sha2("text_ar", 256)), "text_ar")


def variants(records: DataFrame) -> DataFrame:
    """record_id, variant, text_ar and tiers of the full text of records that have addenda."""
    rows = records.where(F.col("addenda_ar").isNotNull() & F.col("text_ar").isNotNull())
    rows = rows.select(F.col("id").alias("record_id"), F.lit(FULL).alias("variant"), full_text(F.col("text_ar"), F.col("addenda_ar")).alias("text_ar"))
    return tiers(rows, "text_ar")


def representations(records: DataFrame, variant_rows: DataFrame) -> DataFrame:
    """All texts by which a record may be found: primaries that may be scored, and every variant, with the record's
    address and whether it opens a chapter with a prefix. At most two for a record."""
    opens = (F.col("ayah") == 1) & F.col("bismillah").isNotNull() if "bismillah" in records.columns else F.lit(False)
    rows = records.withColumn("opens", F.coalesce(opens, F.lit(False)))
    address = ["kind", "surah", "ayah", "collection", "hadith_no", "opens"]
    columns = ["text_ar", "norm_light", "norm_standard", "norm_aggressive"]
    primary = rows.where(F.col("unscorable_reason").isNull()).select(F.col("id").alias("record_id"), F.lit(PRIMARY).alias("variant"), *address, *columns)
    full = variant_rows.join(rows.select(F.col("id").alias("record_id"), *address), "record_id").select("record_id", "variant", *address, *columns)
    return primary.unionByName(full)


def stats(**tables: DataFrame) -> DataFrame:
    """name, row_count of each table."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("name"), "row_count")
        out = part if out is None else out.unionByName(part)
    return out


def scope(records: DataFrame) -> DataFrame:
    """kind, collection, records: what the corpus contains, by which a caveat is worded."""
    return records.groupBy("kind", "collection").agg(F.countDistinct("id").alias("records"))


def translations_of(records: DataFrame, translations: DataFrame, lang: str, limit_to_one: bool = True) -> DataFrame:
    """records with the text of one translation each, the first by source and text, or null."""
    rows = translations.where(F.col("lang") == lang)
    one = rows.groupBy("record_id").agg(F.min(F.struct("source_id", "text")).alias("t")) if limit_to_one else rows.groupBy("record_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_id", "text"))), lambda x: x.text), " ").alias("t"))
    return records.join(one, records["id"] == one["record_id"], "left").drop("record_id")


def fingerprint(df: DataFrame, table: str, columns: list[str], order: list[str]) -> DataFrame:
    """table_name, n_rows, fingerprint of a table, whatever its partitions and order: the digests of its rows are added up
    in eight parts, exactly, before any shuffle, and the sums are digested, so that no task holds more than sums. The
    columns of `order` are part of the row. Null and the empty string differ; a row sent twice counts twice."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NULL))
    rows = df.select(F.sha2(F.concat_ws(FIELD, *map(text, [*order, *columns])), 256).alias("d"))
    parts = [F.coalesce(F.sum(F.conv(F.substr("d", F.lit(8 * i + 1), F.lit(8)), 16, 10).cast("decimal(10,0)")), F.lit(0).cast("decimal(20,0)")).cast("decimal(38,0)").cast("string").alias(f"s{i}") for i in range(8)]
    sums = rows.agg(F.count("*").alias("n_rows"), *parts)
    named = F.concat(F.lit(f"{ROW}table:{table}{FIELD}"), F.concat_ws(FIELD, F.col("n_rows").cast("string"), *[f"s{i}" for i in range(8)]))
    return sums.select(F.lit(table).alias("table_name"), "n_rows", F.sha2(named, 256).alias("fingerprint"))


def stream_fingerprint(tables: list[tuple[str, DataFrame, list[str], list[str]]]) -> str:
    """One digest over ordered rows of several tables, byte by byte, read partition by partition on the driver: for small
    tables whose digest must not depend on buckets. tables: (name, rows, columns, order)."""
    import hashlib

    digest = hashlib.sha256()
    for name, df, columns, order in tables:
        digest.update(f"{ROW}table:{name}{FIELD}".encode())
        for row in df.orderBy(*order).select(*columns).toLocalIterator():
            digest.update((FIELD.join(NULL if v is None else str(v) for v in row) + ROW).encode())
    return digest.hexdigest()


def duplicate_values(df: DataFrame, column: str, id_col: str = "id") -> DataFrame:
    """column, n_ids: values that more than one id shows."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.countDistinct(id_col).alias("n_ids")).where("n_ids > 1")


def incomplete(records: DataFrame) -> DataFrame:
    """id, problem: scorable records with a blank text or without derived columns."""
    blank, bare = F.trim("text_ar") == "", F.col("norm_standard").isNull()
    rows = records.where(F.col("unscorable_reason").isNull()).select("id", F.when(F.col("text_ar").isNull() | blank, "blank text").when(bare, "not derived").alias("problem"))
    return rows.where("problem is not null").distinct()


def stale_digests(records: DataFrame) -> DataFrame:
    """id: records whose stored digest is not that of their text."""
    return records.where(F.col("text_ar_sha256") != F.sha2("text_ar", 256)).select("id").distinct()


def curate(records: DataFrame, curation: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records with the reasons of a digest-pinned curation, its entries that can't be applied: `missing` record or
    `changed` text). curation: record_id, text_sha256, reason. Callers abort on the second with `require_empty`."""
    known = records.select("id", F.sha2("text_ar", 256).alias("now")).distinct()
    state = curation.join(known, curation["record_id"] == known["id"], "left").select("record_id", F.when(F.col("id").isNull(), "missing").when(F.col("now") != F.col("text_sha256"), "changed").alias("problem"))
    pins = curation.select(F.col("record_id").alias("id"), F.col("reason").alias("_reason"))
    out = records.join(pins, "id", "left").withColumn("unscorable_reason", F.coalesce("_reason", "unscorable_reason")).drop("_reason")
    return out.select(*records.columns), state.where("problem is not null")


def whole_in_group(texts: DataFrame, base: DataFrame, group: str, order: str) -> DataFrame:
    """id, group: texts that stand, word for word, within the joined texts of one group of `base` (text, group, order).

    A group's words get running positions, so its text is never put together: its lines are sorted over many tasks, whose
    sums give each the words before it. A text is anchored at its rarest word: each place of that word is a candidate,
    which is kept if all its words stand where they should. Null and blank texts stand nowhere; words stand between spaces.
    """
    words = F.filter(F.split("text", " "), lambda x: x != "")
    lines = base.where(F.col("text").isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(order).alias("o"), "text", F.size(words).alias("n"))
    placed = running(lines, ["g"], ["o", "text"], {"offset": F.col("n")})
    placed = written(placed.select("g", "offset", F.posexplode(words).alias("i", "w")).select("g", (F.col("offset") + F.col("i")).alias("place"), "w"), "placed")
    asked = texts.where(F.trim("text") != "").select("id", "text").distinct().withColumn("t", F.xxhash64("id", "text"))
    needles = asked.select("t", F.size(words).alias("n"), F.posexplode(words).alias("i", "w"))
    frequency = placed.groupBy("w").agg(F.count("*").alias("df"))
    known = needles.join(frequency, "w").groupBy("t", "n").agg(F.count("*").alias("there"), F.min(F.struct("df", "i", "w")).alias("anchor")).where(F.col("there") == F.col("n"))
    starts = known.select("t", "n", F.col("anchor.w").alias("w"), F.col("anchor.i").alias("i")).join(placed, "w").select("t", "n", "g", (F.col("place") - F.col("i")).alias("start"))
    wanted = starts.join(needles.select("t", "i", "w"), "t").withColumn("place", F.col("start") + F.col("i"))
    whole = wanted.join(placed, ["g", "place", "w"]).groupBy("t", "n", "g", "start").agg(F.count("*").alias("right")).where(F.col("right") == F.col("n"))
    return whole.select("t", "g").distinct().join(asked.select("t", "id"), "t").select("id", F.col("g").alias(group)).distinct()


def to_embed(records: DataFrame, variant_rows: DataFrame, stored: DataFrame) -> DataFrame:
    """id, text, text_sha256 of records whose text to embed (the full variant, else the text) has no vector with its digest."""
    full = variant_rows.where(F.col("variant") == FULL).select(F.col("record_id").alias("id"), F.col("text_ar").alias("full_ar"))
    wanted = records.select("id", "text_ar").distinct().join(full, "id", "left").select("id", F.coalesce("full_ar", "text_ar").alias("text"))
    wanted = wanted.withColumn("text_sha256", F.sha2("text", 256))
    done = stored.select(F.col("record_id").alias("id"), "text_sha256").distinct()
    return wanted.where(F.col("text").isNotNull()).join(done, ["id", "text_sha256"], "left_anti").select("id", "text", "text_sha256")


def prefix_collisions(norms: DataFrame, max_dropped: int = 8, min_head_tokens: int = 3) -> DataFrame:
    """id, dropped, other_id: records whose text, less 1 to `max_dropped` last words, is another record's whole text; the
    least drop only, and of equal texts the least id."""
    rows = norms.where(F.col("text").isNotNull())
    words = F.filter(F.split("text", " "), lambda x: x != "")
    heads = rows.select("id", words.alias("w")).where(F.size("w") > min_head_tokens)
    most = F.least(F.lit(max_dropped), F.size("w") - min_head_tokens)
    heads = heads.withColumn("dropped", F.explode(F.sequence(F.lit(1), most))).select("id", "dropped", F.array_join(F.slice("w", F.lit(1), F.size("w") - F.col("dropped")), " ").alias("text"))
    whole = rows.groupBy("text").agg(F.min("id").alias("other_id"))
    hit = heads.join(whole, "text").where(F.col("id") != F.col("other_id"))
    return hit.groupBy("id").agg(F.min(F.struct("dropped", "other_id")).alias("h")).select("id", F.col("h.dropped").alias("dropped"), F.col("h.other_id").alias("other_id"))


def near_misses(texts: DataFrame, configured: str, sweep: str) -> DataFrame:
    """id of texts that the wider pattern finds and the configured one doesn't."""
    return texts.where(~F.col("text").rlike(configured) & F.col("text").rlike(sweep)).select("id").distinct()


def noise(texts: DataFrame) -> DataFrame:
    """id, signs: the distinct characters of each text outside Arabic and white space, in order."""
    chars = F.filter(F.split("text", ""), lambda c: (c != "") & ~c.rlike("(?U)[\\x{600}-\\x{6ff}\\s]"))
    return texts.select("id", F.array_join(F.array_sort(F.array_distinct(chars)), "").alias("signs")).where("signs <> ''").distinct()


def noise_report(texts: DataFrame) -> DataFrame:
    """sign, n_ids: in how many records each stray character stands."""
    return noise(texts).select("id", F.explode(F.split("signs", "")).alias("sign")).where("sign <> ''").groupBy("sign").agg(F.countDistinct("id").alias("n_ids"))


def occurrences(rows: DataFrame, number: str, order: str) -> DataFrame:
    """rows with occurrence: 1 for the first of each number, 2 for the next, by `order`."""
    return running(rows, [number], [order], {"_earlier": F.lit(1)}).withColumn("occurrence", F.col("_earlier") + 1).drop("_earlier")


def content_mass(text: Column, scaffold: list[str], introduces: list[str]) -> Column:
    """Words of a text that say something: words of `scaffold` don't count, nor does the word after one of `introduces`."""
    words = F.filter(F.split(text, " "), lambda x: x != "")
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("named"))

    def step(acc: Column, w: Column) -> Column:
        opens = w.isin(introduces)
        counts = ~opens & ~acc.named & ~w.isin(scaffold)
        return F.struct((acc.n + counts.cast("int")).alias("n"), opens.alias("named"))

    return F.aggregate(words, start, step, lambda acc: acc.n)


def pointer_population(norms: DataFrame, tokens: list[str], scaffold: list[str], introduces: list[str], most: int = 7) -> DataFrame:
    """id, mass: texts that a sweep for pointers has to read: those that say at most `most` words, and those with one of
    `tokens`."""
    rows = norms.where(F.col("text").isNotNull()).select("id", content_mass(F.col("text"), scaffold, introduces).alias("mass"), F.arrays_overlap(F.split("text", " "), F.array(*map(F.lit, tokens))).alias("refers"))
    return rows.where((F.col("mass") <= most) | F.col("refers")).select("id", "mass").distinct()


def pure_pointers(norms: DataFrame, anchors: list[str], scaffold: list[str], introduces: list[str], max_residue: int = 2, but_not: str | None = None) -> DataFrame:
    """id, residue: texts with an anchor word of which at most `max_residue` words remain beside scaffold and names. Texts
    that match `but_not`, which tell how something was delivered, are left out."""
    words = F.split("text", " ")
    rows = norms.where(F.arrays_overlap(words, F.array(*map(F.lit, anchors))))
    rows = rows if but_not is None else rows.where(~F.col("text").rlike(but_not))
    return rows.select("id", content_mass(F.col("text"), [*scaffold, *anchors], introduces).alias("residue")).where(F.col("residue") <= max_residue).distinct()
