"""The queries of the training-data operators, one per operator, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from .bpe import bpe_decode, bpe_encode
from .common import table
from .exact_dedup import exact_dedup
from .fingerprints import NEAR_LANES, SUM_LANES, edited_fingerprints
from .html_extract import extract
from .license_scan import TEMPLATES, license_scan, template_bigrams
from .mixing import mix
from .near_dedup import near_dedup
from .quality_crf import held_out, score, train
from .secret_scan import BASE, KINDS, WEAK, secret_scan
from .sharding import lookup_table, shard

SHARDS = tuple(f"shard-{i:03}" for i in range(64))
SLOTS = 4099


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _part_sql(kind: str) -> str:
    """doc_id, kind (number), start, stop, found of one kind of part; RE2 has no look-behind, its \\b stands for the one used."""
    pattern, group, least = (*BASE[kind],) if kind in BASE else (WEAK[kind].replace("(?<![A-Za-z0-9_])", r"\b"), 0, 0)
    p = _quoted(pattern)
    return f"""SELECT doc_id, {KINDS.index(kind)} AS kind, start, start + length(found) AS stop, found FROM (
        SELECT doc_id, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start, f[i] AS found, m[i] AS measured
        FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM (SELECT doc_id, string_split_regex(t, {p}) AS gaps, regexp_extract_all(t, {p}) AS f, regexp_extract_all(t, {p}, {group}) AS m FROM docs)))
        WHERE length(measured) >= {least}"""


_SECRET_SQL = rf"""
    WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    base AS ({" UNION ALL ".join(map(_part_sql, BASE))}),
    weak AS (SELECT * FROM ({" UNION ALL ".join(map(_part_sql, WEAK))}) WHERE kind <> 4 OR regexp_matches(found, '[A-Z]') AND regexp_matches(found, '[a-z]') AND regexp_matches(found, '[0-9]')),
    clear AS (SELECT * FROM weak w WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = w.doc_id AND b.start < w.stop AND w.start < b.stop)
        AND NOT (kind = 4 AND EXISTS (SELECT 1 FROM weak e WHERE e.kind = 5 AND e.doc_id = w.doc_id AND e.start < w.stop AND w.start < e.stop))),
    parts AS (SELECT * FROM base UNION ALL SELECT * FROM clear),
    near AS (
        SELECT x.doc_id, x.kind, x.start, x.stop, bool_or(y.kind IN (1, 3)) AS id, bool_or(y.kind IN (0, 2, 4)) AS secret, bool_or(y.kind = 5) AS address
        FROM clear x JOIN parts y ON x.doc_id = y.doc_id AND (x.kind, x.start) <> (y.kind, y.start) AND y.start - x.stop <= 256 AND x.start - y.stop <= 256 GROUP BY ALL),
    linked AS (SELECT doc_id, kind, start, stop FROM near WHERE kind = 4 AND (id OR address) OR kind = 3 AND secret OR kind = 5 AND id AND secret),
    named AS (SELECT doc_id, kind, start, {KINDS!r}[kind + 1] || ':' || start || ':' || stop AS s, base FROM (SELECT doc_id, kind, start, stop, true AS base FROM base UNION ALL SELECT *, false FROM linked)),
    told AS (
        SELECT doc_id, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS k, count(*) FILTER (kind = 2) AS h, count(*) FILTER (NOT base) AS l,
            string_agg(s, ',' ORDER BY start, kind) FILTER (base) AS b, string_agg(s, ',' ORDER BY start, kind) AS spans FROM named GROUP BY doc_id)
    SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(k, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(l, 0)::BIGINT AS n_linked
    FROM docs LEFT JOIN told USING (doc_id)""".replace(repr(KINDS), "[" + ", ".join(map(_quoted, KINDS)) + "]")

_listed = lambda items: f"[{', '.join(map(_quoted, items))}]"
_TEMPLATE_ROWS = ", ".join(f"({k}, {_quoted(t['name'])}, {_listed(t['order'])}, {_listed(t['pairs'])}, {_listed(t['anchors'])})" for k, t in enumerate(template_bigrams(TEMPLATES)))


def ranks() -> tuple[str, str]:
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), width=2)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_decode(bpe_encode(table(spark, sf_dir, "documents").select("doc_id", "text"), *ranks()), ranks()[0])
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents").select("doc_id"), shards=SHARDS, slots=SLOTS).select("doc_id", "slot", "shard")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    model = train(docs.where(~F.col("held_out")), table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    scored = score(docs, model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_bpe": op2_bpe,
    "op3_extract": op3_extract,
    "op4_fingerprint": op4_fingerprint,
    "op5_shard": op5_shard,
    "op6_quality": op6_quality,
    "op7_mix": op7_mix,
    "op8_secret_scan": op8_secret_scan,
    "op9_license_scan": op9_license_scan,
    "op10_exact_dedup": op10_exact_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op1_near_dedup": r"""
        WITH RECURSIVE worded AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        sets AS (
            SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS s FROM worded),
        classed AS (SELECT doc_id, len(s)::BIGINT AS n, CASE WHEN len(s) > 0 THEN min(doc_id) OVER (PARTITION BY s) ELSE doc_id END AS class_id, s FROM sets),
        heads AS (SELECT * FROM classed WHERE doc_id = class_id AND n > 0),
        items AS (SELECT doc_id, n, unnest(s) AS x FROM heads),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS total, count(*) AS met FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM common WHERE 100 * met >= 80 * (total - met)),
        reach(v, x) AS (SELECT doc_id, doc_id FROM heads UNION SELECT v, b FROM reach JOIN links ON x = a),
        least AS (SELECT v, min(x) AS comp FROM reach GROUP BY v)
        SELECT doc_id, n AS n_shingles, coalesce(comp, doc_id) AS component_id, coalesce(comp, doc_id) = doc_id AS kept, class_id FROM classed LEFT JOIN least ON class_id = v""",
    "op4_fingerprint": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n FROM documents),
        nexts AS (
            SELECT *, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nt FROM d
            WINDOW w AS (ORDER BY doc_id DESC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
        versions AS (
            SELECT doc_id, n, t AS t0, left(t, n - n // 2) || left(nt, n // 2) AS t1, nt AS t2 FROM nexts),
        texts AS (
            SELECT doc_id, which, unnest(string_split(t, chr(10))) AS p
            FROM (SELECT doc_id, unnest([0, 1, 2]) AS which, unnest([t0, t1, t2]) AS t FROM versions)),
        lanes AS (
            SELECT doc_id, which, i * 4 + k AS lane, sum(('0x' || substr(md5(i || ':' || p), 8 * k + 1, 8))::BIGINT) % 4294967296 AS v
            FROM texts, range({SUM_LANES // 4}) a(i), range(4) b(k) GROUP BY ALL),
        summed AS (SELECT doc_id, which, string_agg(printf('%08x', v::BIGINT), '' ORDER BY lane) AS f FROM lanes GROUP BY ALL),
        said AS (SELECT doc_id, which, s, md5(s) AS h FROM (SELECT doc_id, which, unnest(string_split(p, '. ')) AS s FROM texts) WHERE s <> ''),
        sparse AS (
            SELECT doc_id, which, ('0x' || substr(h, 1, 4))::BIGINT % {NEAR_LANES} AS lane,
                sum(greatest(1, round(sqrt(length(s)) * 4)::BIGINT) * CASE WHEN substr(h, 5, 1) >= '8' THEN 1 ELSE -1 END) AS v
            FROM said GROUP BY ALL),
        dense AS (
            SELECT doc_id, which, lane, ((coalesce(v, 0)::BIGINT + 32768) % 65536 + 65536) % 65536 - 32768 AS v
            FROM (SELECT doc_id, which, lane FROM (SELECT doc_id FROM d), range(3) w(which), range({NEAR_LANES}) l(lane)) LEFT JOIN sparse USING (doc_id, which, lane)),
        vectors AS (
            SELECT doc_id, which, string_agg(printf('%04x', ((v + 65536) % 65536)::BIGINT), '' ORDER BY lane) AS f, list(v ORDER BY lane) AS v, sum(v * v)::BIGINT AS norm
            FROM dense GROUP BY ALL),
        wide AS (SELECT doc_id, which, s.f || ':' || v.f AS f, v.v, v.norm FROM summed s JOIN vectors v USING (doc_id, which)),
        likes AS (
            SELECT a.doc_id, b.which, CASE WHEN a.f = b.f OR greatest(a.norm, b.norm) = 0 THEN 1.0::DOUBLE
                ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, list_sum(list_transform(range(1, {NEAR_LANES + 1}), lambda i: a.v[i] * b.v[i]))::DOUBLE / greatest(a.norm, b.norm))) END AS near
            FROM wide a JOIN wide b USING (doc_id) WHERE a.which = 0)
        SELECT doc_id, n AS n_chars, sha256(t1) AS edited_sha256, a.f AS fingerprint, b.f AS edited_fingerprint, l1.near AS near_edited, l2.near AS near_next
        FROM versions JOIN (SELECT * FROM wide WHERE which = 0) a USING (doc_id) JOIN (SELECT * FROM wide WHERE which = 1) b USING (doc_id)
        JOIN (SELECT * FROM likes WHERE which = 1) l1 USING (doc_id) JOIN (SELECT * FROM likes WHERE which = 2) l2 USING (doc_id)""",
    "op5_shard": f"""
        WITH placed AS (SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS})::INTEGER AS slot FROM documents)
        SELECT doc_id, slot, 'shard-' || lpad(string_split('{",".join(map(str, lookup_table(SHARDS, SLOTS)))}', ',')[slot + 1], 3, '0') AS shard FROM placed""",
    "op7_mix": r"""
        WITH sized AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS u
            FROM documents),
        sources AS (
            SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
            FROM sized GROUP BY source),
        ranked AS (
            SELECT *, row_number() OVER (ORDER BY 2 * source_size / w, source NULLS LAST) AS k,
                1.5::DOUBLE * (SELECT sum(source_size) FROM sources)::DOUBLE
                    - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS rest,
                sum(w) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS rest_w
            FROM sources),
        level AS (SELECT rest / rest_w AS l FROM ranked WHERE rest / rest_w * w <= 2 * source_size ORDER BY k LIMIT 1),
        filled AS (
            SELECT source, source_size, least((2 * source_size)::DOUBLE, coalesce((SELECT l FROM level), 1e300) * w) AS target FROM sources),
        cut AS (
            SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM filled),
        placed AS (
            SELECT d.doc_id, d.size, c.source_size, c.target, c.whole, round(c.target)::BIGINT - c.whole * c.source_size AS more,
                sum(d.size) OVER (PARTITION BY c.source ORDER BY d.u, d.doc_id, d.size ROWS UNBOUNDED PRECEDING)::BIGINT - d.size AS before
            FROM sized d JOIN cut c ON d.source IS NOT DISTINCT FROM c.source)
        SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, more - before)))::BIGINT AS taken FROM placed""",
    "op8_secret_scan": _SECRET_SQL,
    "op9_license_scan": rf"""
        WITH known(k, name, ord, pairs, anchors) AS (VALUES {_TEMPLATE_ROWS}),
        segments AS (
            SELECT doc_id, unnest(list_concat(string_split(coalesce(text, ''), chr(10)),
                CASE WHEN contains(text, chr(10) || chr(10)) THEN list_filter(string_split_regex(text, '\n{{2,}}'), lambda p: contains(p, chr(10))) ELSE [] END,
                CASE WHEN contains(text, chr(10)) THEN [text] ELSE [] END)) AS segment
            FROM documents),
        worded AS (
            SELECT doc_id, true AS part, list_filter(string_split_regex(lower(regexp_replace(segment, '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '') AS w FROM segments
            UNION ALL SELECT doc_id, false, list_filter(string_split_regex(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '') FROM documents),
        paired AS (SELECT doc_id, part, row_number() OVER () AS s, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS own FROM worded WHERE len(w) > 1),
        scored AS (
            SELECT doc_id, s, name, -2.0::DOUBLE * len(list_intersect(own, pairs)) / (len(list_distinct(own)) + len(pairs)) AS d FROM paired, known WHERE part),
        best AS (SELECT doc_id, true AS part, min(struct_pack(d := d, name := name)) AS m FROM scored WHERE d <= -0.8 GROUP BY doc_id, s),
        placed AS (
            SELECT doc_id, k, name, ord, pairs, own, unnest(list_distinct(list_transform(list_filter(range(1, len(own) + 1), lambda i: list_contains(anchors, own[i])), lambda i: greatest(1, i - list_position(ord, own[i]) + 1)))) AS start
            FROM paired, known WHERE NOT part AND list_has_any(anchors, own)),
        cut AS (SELECT doc_id, k, name, pairs, list_distinct(own[start:start + len(ord) - 1]) AS own FROM placed),
        windows AS (SELECT doc_id, false AS part, min(struct_pack(d := -2.0::DOUBLE * len(list_intersect(own, pairs)) / (len(own) + len(pairs)), name := name)) AS m FROM cut GROUP BY doc_id, k),
        every AS (SELECT * FROM best UNION ALL SELECT * FROM windows WHERE m.d <= -0.8),
        per AS (SELECT doc_id, count(*) FILTER (part) AS n, count(*) FILTER (NOT part) AS n_w, string_agg(DISTINCT m.name, ',' ORDER BY m.name) AS licenses, min(m) AS m FROM every GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_matches, coalesce(n_w, 0)::BIGINT AS n_windows, coalesce(licenses, '') AS licenses, m.name AS best_license, coalesce(-m.d, 0.0)::DOUBLE AS best_dice
        FROM documents d LEFT JOIN per USING (doc_id)""",
    "op10_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
            doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n""",
}
