"""Queries over the corpus as tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotewright.operators import corpus as op
from quotewright.operators import rules
from quotewright.plans.text import tier_sql
from quotewright.runtime import table
from quotewright.streaming import audit


def records_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """records, each id once: the row that came last."""
    return op.latest_rows(table(spark, sf_dir, "records"), ["id"], ["loaded_at", "row_no"])


def representations(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records_once(spark, sf_dir)
    rows = op.representations(r, op.variants(r))
    return rows.select("record_id", "variant", "kind", F.sha2(F.concat_ws("|", "norm_light", "norm_standard", "norm_aggressive"), 256).alias("norms_sha256"))


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, where urgent ones are sent again with a total one higher: the later row of each key."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.floor(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    again = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").startswith("1")).select("o_orderkey", "o_custkey", F.lit("U").alias("o_orderstatus"), (F.floor(F.col("o_totalprice") * 100) + 1).cast("long").alias("cents"))
    return op.upsert(o, again, ["o_orderkey"], ["cents"])


def latest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order of each customer."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    return op.latest_rows(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


def translation_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with one English translation, or none."""
    r = table(spark, sf_dir, "records").select("id").distinct()
    rows = op.translations_of(r, table(spark, sf_dir, "translations"), "en")
    return rows.select("id", F.col("t.source_id").alias("source_id"), F.sha2("t.text", 256).alias("text_sha256"))


def translation_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with all their English translations, in order, as one text."""
    r = table(spark, sf_dir, "records").select("id").distinct()
    return op.translations_of(r, table(spark, sf_dir, "translations"), "en", limit_to_one=False).select("id", F.sha2("t", 256).alias("text_sha256"))


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.stats(**{t: table(spark, sf_dir, t) for t in ("records", "sources", "translations", "gradings", "record_vectors")})


def corpus_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.scope(table(spark, sf_dir, "records"))


_SOURCE_COLUMNS = ["kind", "title", "publisher", "edition", "url", "license_id", "license_url", "attribution", "upstream_sha256", "modifications"]
_RECORD_COLUMNS = ["source_id", "kind", "surah", "ayah", "surah_name_ar", "surah_name_en", "collection", "book_no", "chapter_ar", "hadith_no", "numbering_scheme", "text_ar", "bismillah", "isnad_ar", "addenda_ar", "unscorable_reason", "reference_display"]
_DERIVED_COLUMNS = ["text_ar_sha256", "norm_light", "norm_standard", "norm_aggressive"]


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of sources, translations and records as sent, of records with what is derived, of variants, and of the list of
    what is indexed."""
    t = lambda name: table(spark, sf_dir, name)
    once = records_once(spark, sf_dir)
    held = op.variants(once)
    parts = [
        op.fingerprint(t("sources"), "sources", _SOURCE_COLUMNS, ["id"]), op.fingerprint(t("records"), "records_source", _RECORD_COLUMNS, ["id"]),
        op.fingerprint(t("records"), "records", [*_RECORD_COLUMNS, *_DERIVED_COLUMNS], ["id"]), op.fingerprint(t("translations"), "translations", ["lang", "text"], ["record_id", "source_id"]),
        op.fingerprint(held, "record_variants", ["text_ar", "norm_light", "norm_standard", "norm_aggressive"], ["record_id", "variant"]), op.fingerprint(op.representations(once, held), "indexed", [], ["record_id", "variant"]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dup_reference_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.duplicate_values(table(spark, sf_dir, "records"), "reference_display")


def complete_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.incomplete(table(spark, sf_dir, "records"))


def stale_digest_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.stale_digests(table(spark, sf_dir, "records"))


def curation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed and unscorable records as a digest-pinned curation: what can't be applied."""
    r = table(spark, sf_dir, "records")
    pins = r.where("unscorable_reason is not null").select(F.col("id").alias("record_id"), F.col("text_ar_sha256").alias("text_sha256"), F.col("unscorable_reason").alias("reason"))
    gone = table(spark, sf_dir, "removals").where("tab = 'records'").select(F.col("key_value").alias("record_id"), F.lit("none").alias("text_sha256"), F.lit("removed").alias("reason"))
    return op.curate(r, pins.unionByName(gone).distinct())[1].distinct()


def group_containment_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of one kind that stand whole within a chapter of the other."""
    r = records_once(spark, sf_dir)
    texts = r.where("kind = 'hadith' and unscorable_reason is null and norm_standard is not null").select("id", F.col("norm_standard").alias("text"))
    base = r.where("kind = 'ayah' and norm_standard is not null").select("surah", "ayah", F.col("norm_standard").alias("text"))
    return op.whole_in_group(texts, base, "surah", "ayah")


def embed_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records_once(spark, sf_dir)
    rows = op.to_embed(r, op.variants(r).select("record_id", "variant", "text_ar"), table(spark, sf_dir, "record_vectors"))
    return rows.select("id", "text_sha256")


def vectors_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and span of each model's vectors."""
    return table(spark, sf_dir, "record_vectors").groupBy("model", "dim", "dtype").agg(F.count("*").alias("vectors"), F.countDistinct("record_id").alias("records"))


def prefix_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "records").select("id", F.col("norm_standard").alias("text")).distinct()
    return op.prefix_collisions(r)


CONFIGURED, SWEEP = "(^| )حدثنا( |$)", "حدثنا|اخبرنا|عن"
SCAFFOLD, INTRODUCES, ANCHORS = ["قال", "قد", "ثم", "هذا", "ذلك", "في", "من"], ["عن", "بن"], ["مثله", "نحوه", "هذا"]


def near_miss_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "records").where("norm_aggressive is not null").select("id", F.col("norm_aggressive").alias("text"))
    return op.near_misses(r, CONFIGURED, SWEEP)


def content_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each record that are neither scaffold nor names."""
    return table(spark, sf_dir, "records").where("norm_aggressive is not null").select("row_no", op.content_mass(F.col("norm_aggressive"), SCAFFOLD, INTRODUCES).cast("long").alias("mass"))


def pure_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "records").where("norm_aggressive is not null").select("id", F.col("norm_aggressive").alias("text"))
    return op.pure_pointers(r, ANCHORS, SCAFFOLD, INTRODUCES, max_residue=12).select("id", F.col("residue").cast("long").alias("residue"))


def noise_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.noise_report(table(spark, sf_dir, "records").select("id", F.col("text_ar").alias("text")))


def number_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The how manieth of its printed number each record is."""
    r = table(spark, sf_dir, "records").where("collection is not null and hadith_no is not null").select("row_no", F.concat_ws(" ", "collection", "hadith_no").alias("number"))
    return op.occurrences(r, "number", "row_no").select("row_no", "number", F.col("occurrence").cast("long").alias("occurrence"))


def audit_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.event_audit(table(spark, sf_dir, "events"))


def audit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and kind."""
    w = audit.windowed(table(spark, sf_dir, "events"), "1 day")
    return w.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def audit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same audit rows through a stream that reads the event files once."""
    import uuid

    from quotewright.runtime import shared_dir

    base = f"{shared_dir(spark).rstrip('/')}/quotewright/audit-{uuid.uuid4().hex[:12]}"
    audit.stream(spark, sf_dir, "events.parquet", f"{base}/rows", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/rows").select(*audit.COLUMNS)


def stray_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded records that aren't in the corpus."""
    r = table(spark, sf_dir, "records").select(F.col("id").alias("record_id")).distinct()
    return table(spark, sf_dir, "gradings").where("record_id is not null").select("record_id").distinct().join(r, "record_id", "left_anti")


def known_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that documents speak of and the corpus has."""
    r = table(spark, sf_dir, "records").select(F.col("id").alias("record_id")).distinct()
    return table(spark, sf_dir, "documents").where("record_id is not null").select("doc_id", "record_id").join(r, "record_id", "left_semi").select("doc_id", "record_id")


def thread_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of the last ten translations of a record, up to each."""
    t = rules.running_text(table(spark, sf_dir, "translations").select("row_no", "record_id", "text"), "record_id", "row_no", "text")
    return t.select("row_no", F.sha2("context", 256).alias("context_sha256"))


def sources_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source with its records, also those without."""
    s = table(spark, sf_dir, "sources").select("id", "kind")
    n = table(spark, sf_dir, "records").groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("records"))
    return s.join(n, "id", "left").select("id", "kind", F.coalesce("records", F.lit(0)).cast("long").alias("records"))


QUERIES = {f.__name__: f for f in (
    representations, upsert_latest, latest_orders, translation_one, translation_joined, corpus_stats, corpus_scope, fingerprints, dup_reference_gate, complete_gate,
    stale_digest_gate, curation_gate, group_containment_gate, embed_incremental, vectors_meta, prefix_collisions, near_miss_sweep, content_mass, pure_pointers,
    noise_report, number_occurrences, audit_append, audit_windows, audit_stream, stray_ids, known_ids, thread_context, sources_left,
)}

_ONCE = "once AS (SELECT * FROM records QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, row_no DESC) = 1)"
_FULL = "full_rows AS (SELECT id, kind, text_ar || ' ' || addenda_ar AS t FROM once WHERE addenda_ar IS NOT NULL AND text_ar IS NOT NULL)"


def _fingerprint_sql(rows: str, name: str, columns: list[str], order: tuple[str, ...] = ("id",)) -> str:
    text = ", ".join(f"coalesce({c}::VARCHAR, chr(0))" for c in [*order, *columns])
    sums = " || chr(31) || ".join(f"coalesce(sum(('0x' || substr(d, {8 * i + 1}, 8))::BIGINT), 0)::HUGEINT::VARCHAR" for i in range(8))
    return f"SELECT '{name}' AS table_name, count(*) AS n_rows, sha256(chr(30) || 'table:{name}' || chr(31) || count(*)::VARCHAR || chr(31) || {sums}) AS fingerprint FROM (SELECT sha256(concat_ws(chr(31), {text})) AS d FROM {rows})"


_MASS = "list_reduce(list_prepend({'n': 0, 'named': false, 'w': ''}, list_transform(list_filter(string_split(norm_aggressive, ' '), lambda x: x <> ''), lambda x: {'n': 0, 'named': false, 'w': x})), lambda a, b: {'n': a.n + CASE WHEN b.w NOT IN (%(intro)s) AND NOT a.named AND b.w NOT IN (%(scaffold)s) THEN 1 ELSE 0 END, 'named': b.w IN (%(intro)s), 'w': ''}).n"
_q = lambda words: ", ".join(f"'{w}'" for w in words)

SQL = {
    "representations": f"WITH {_ONCE}, {_FULL} SELECT id AS record_id, 'primary' AS variant, kind, sha256(concat_ws('|', norm_light, norm_standard, norm_aggressive)) AS norms_sha256 FROM once WHERE unscorable_reason IS NULL UNION ALL SELECT id, 'full', kind, sha256(concat_ws('|', {tier_sql('light', 't')}, {tier_sql('standard', 't')}, {tier_sql('aggressive', 't')})) FROM full_rows",
    "upsert_latest": "SELECT o_orderkey, o_custkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'U' ELSE o_orderstatus END AS o_orderstatus, (floor(o_totalprice * 100) + CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END)::BIGINT AS cents FROM orders",
    "latest_orders": "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC, o_orderstatus DESC) = 1",
    "translation_one": "SELECT r.id, t.source_id, sha256(t.text) AS text_sha256 FROM (SELECT DISTINCT id FROM records) r LEFT JOIN (SELECT * FROM translations WHERE lang = 'en' QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY source_id, text) = 1) t ON r.id = t.record_id",
    "translation_joined": "SELECT r.id, sha256(t.text) AS text_sha256 FROM (SELECT DISTINCT id FROM records) r LEFT JOIN (SELECT record_id, string_agg(text, ' ' ORDER BY source_id, text) AS text FROM translations WHERE lang = 'en' GROUP BY record_id) t ON r.id = t.record_id",
    "corpus_stats": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS row_count FROM {t}" for t in ("records", "sources", "translations", "gradings", "record_vectors")),
    "corpus_scope": "SELECT kind, collection, count(DISTINCT id) AS records FROM records GROUP BY ALL",
    "fingerprints": f"WITH {_ONCE}, {_FULL}, variants AS (SELECT id AS record_id, 'full' AS variant, t AS text_ar, {tier_sql('light', 't')} AS norm_light, {tier_sql('standard', 't')} AS norm_standard, {tier_sql('aggressive', 't')} AS norm_aggressive FROM full_rows), indexed AS (SELECT id AS record_id, 'primary' AS variant FROM once WHERE unscorable_reason IS NULL UNION ALL SELECT record_id, variant FROM variants) "
    + " UNION ALL ".join([
        _fingerprint_sql("sources", "sources", _SOURCE_COLUMNS), _fingerprint_sql("records", "records_source", _RECORD_COLUMNS), _fingerprint_sql("records", "records", [*_RECORD_COLUMNS, *_DERIVED_COLUMNS]),
        _fingerprint_sql("translations", "translations", ["lang", "text"], ("record_id", "source_id")), _fingerprint_sql("variants", "record_variants", ["text_ar", "norm_light", "norm_standard", "norm_aggressive"], ("record_id", "variant")), _fingerprint_sql("indexed", "indexed", [], ("record_id", "variant")),
    ]),
    "dup_reference_gate": "SELECT reference_display, count(DISTINCT id) AS n_ids FROM records GROUP BY 1 HAVING count(DISTINCT id) > 1",
    "complete_gate": "SELECT DISTINCT id, CASE WHEN text_ar IS NULL OR trim(text_ar) = '' THEN 'blank text' ELSE 'not derived' END AS problem FROM records WHERE unscorable_reason IS NULL AND (text_ar IS NULL OR trim(text_ar) = '' OR norm_standard IS NULL)",
    "stale_digest_gate": "SELECT DISTINCT id FROM records WHERE text_ar_sha256 <> sha256(text_ar)",
    "curation_gate": "WITH pins AS (SELECT id AS record_id, text_ar_sha256 AS d FROM records WHERE unscorable_reason IS NOT NULL UNION SELECT key_value, 'none' FROM removals WHERE tab = 'records'), known AS (SELECT DISTINCT id, sha256(text_ar) AS now FROM records) SELECT DISTINCT record_id, CASE WHEN id IS NULL THEN 'missing' ELSE 'changed' END AS problem FROM pins LEFT JOIN known ON record_id = id WHERE id IS NULL OR now <> d",
    "group_containment_gate": f"WITH {_ONCE}, blobs AS (SELECT surah, ' ' || string_agg(norm_standard, ' ' ORDER BY ayah, norm_standard) || ' ' AS blob FROM once WHERE kind = 'ayah' AND norm_standard IS NOT NULL GROUP BY surah) SELECT id, blobs.surah AS surah FROM once JOIN blobs ON contains(blob, ' ' || norm_standard || ' ') WHERE kind = 'hadith' AND unscorable_reason IS NULL AND trim(norm_standard) <> ''",
    "embed_incremental": f"WITH {_ONCE}, wanted AS (SELECT id, sha256(CASE WHEN addenda_ar IS NULL THEN text_ar ELSE text_ar || ' ' || addenda_ar END) AS d FROM once WHERE text_ar IS NOT NULL) SELECT id, d AS text_sha256 FROM wanted WHERE NOT EXISTS (SELECT 1 FROM record_vectors v WHERE v.record_id = id AND v.text_sha256 = d)",
    "vectors_meta": "SELECT model, dim, dtype, count(*) AS vectors, count(DISTINCT record_id) AS records FROM record_vectors GROUP BY ALL",
    "prefix_collisions": "WITH one AS (SELECT DISTINCT id, norm_standard AS text FROM records WHERE norm_standard IS NOT NULL), w AS (SELECT id, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM one), heads AS (SELECT id, unnest(range(1, least(8, len(w) - 3) + 1)) AS dropped, w FROM w WHERE len(w) > 3), hit AS (SELECT h.id, h.dropped, o.other_id FROM heads h JOIN (SELECT text, min(id) AS other_id FROM one GROUP BY text) o ON o.text = array_to_string(h.w[1:len(h.w) - h.dropped], ' ') WHERE o.other_id <> h.id) SELECT id, dropped::INT AS dropped, other_id FROM hit QUALIFY row_number() OVER (PARTITION BY id ORDER BY dropped, other_id) = 1",
    "near_miss_sweep": f"SELECT DISTINCT id FROM records WHERE norm_aggressive IS NOT NULL AND NOT regexp_matches(norm_aggressive, '{CONFIGURED}') AND regexp_matches(norm_aggressive, '{SWEEP}')",
    "content_mass": f"SELECT row_no, ({_MASS % {'intro': _q(INTRODUCES), 'scaffold': _q(SCAFFOLD)}})::BIGINT AS mass FROM records WHERE norm_aggressive IS NOT NULL",
    "pure_pointers": f"SELECT DISTINCT id, residue FROM (SELECT id, ({_MASS % {'intro': _q(INTRODUCES), 'scaffold': _q([*SCAFFOLD, *ANCHORS])}})::BIGINT AS residue FROM records WHERE norm_aggressive IS NOT NULL AND list_has_any(string_split(norm_aggressive, ' '), [{_q(ANCHORS)}])) WHERE residue <= 12",
    "noise_report": "SELECT sign, count(DISTINCT id) AS n_ids FROM (SELECT id, unnest(string_split(text_ar, '')) AS sign FROM records) WHERE NOT regexp_matches(sign, '[\\x{600}-\\x{6ff}\\s\\x{0b}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]') AND sign <> '' GROUP BY sign",
    "number_occurrences": "SELECT row_no, collection || ' ' || hadith_no AS number, row_number() OVER (PARTITION BY collection || ' ' || hadith_no ORDER BY row_no) AS occurrence FROM records WHERE collection IS NOT NULL AND hadith_no IS NOT NULL",
    **{q: "SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, event_id::VARCHAR AS request_id, event_type AS stage, CASE WHEN value IS NULL THEN 'none' WHEN value < 0 THEN 'negative' ELSE 'recorded' END AS verdict, props AS detail_json FROM events" for q in ("audit_append", "audit_stream")},
    "audit_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stray_ids": "SELECT DISTINCT record_id FROM gradings WHERE record_id IS NOT NULL AND record_id NOT IN (SELECT id FROM records WHERE id IS NOT NULL)",
    "known_ids": "SELECT doc_id, record_id FROM documents WHERE record_id IN (SELECT id FROM records)",
    "thread_context": "SELECT row_no, sha256(string_agg(text, ' ') OVER (PARTITION BY record_id ORDER BY row_no ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) AS context_sha256 FROM translations",
    "sources_left": "SELECT s.id, s.kind, count(r.row_no) AS records FROM sources s LEFT JOIN records r ON s.id = r.source_id GROUP BY ALL",
}
