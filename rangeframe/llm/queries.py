"""One query per operator over its whole table, and SQL for those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate,
    fill_middle,
    html_extract,
    license_scan,
    line_dedup,
    merkle,
    mixing,
    packing,
    quality,
    resample,
    sharding,
    simhash,
    url_filter,
)
from .common import table

URL_RULES = (
    url_filter.Rule("org", "/", "allow"),
    url_filter.Rule("example.org", "/es/", "block"),
    url_filter.Rule("example.org", "/en/1", "block"),
    url_filter.Rule("com", "/fr/", "allow"),
    url_filter.Rule("com", "/de/", "block"),
)
SHARDS = tuple(f"shard-{n:02d}" for n in range(32))


def op1_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf, "pages"))


def op2_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    leaks = decontaminate.find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return leaks.select("doc_id", "item_id", "n_copies", "n_shared", "n_shingles", "containment")


def op3_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.edited_fingerprints(table(spark, sf, "documents"))


def op4_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf, "pages"), URL_RULES)


def op5_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.score_documents(table(spark, sf, "documents"), table(spark, sf, "labels")).drop("mark")


def op6_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf, "documents"))


def op7_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    kept = line_dedup.drop_common_lines(table(spark, sf, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_simhash(spark: SparkSession, sf: str) -> DataFrame:
    grouped = simhash.simhash_groups(table(spark, sf, "documents"))
    shown = F.lower(F.lpad(F.hex(F.element_at("lanes", 1)), 16, "0"))
    return grouped.select("doc_id", shown.alias("fingerprint"), "component_id")


def op9_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"))


def op10_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.place(table(spark, sf, "documents").select("doc_id"), "doc_id", SHARDS)


def op11_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents")).drop("row")


def op12_fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf, "documents"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    digests = (F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_resampling(spark: SparkSession, sf: str) -> DataFrame:
    ranked = resample.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return ranked.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_decontamination": op2_decontamination,
    "op3_fingerprints": op3_fingerprints,
    "op4_url_filter": op4_url_filter,
    "op5_quality": op5_quality,
    "op6_license_scan": op6_license_scan,
    "op7_line_dedup": op7_line_dedup,
    "op8_simhash": op8_simhash,
    "op9_mixing": op9_mixing,
    "op10_sharding": op10_sharding,
    "op11_packing": op11_packing,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_resampling": op13_resampling,
}

# -- the same in SQL ------------------------------------------------------------


_A_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_BLANKS = r"[\x20\x09-\x0D]"


def _url_sql() -> str:
    ordered = sorted(URL_RULES, key=lambda r: -len(r.name))
    fits = {r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in ordered}
    name = " ".join(f"WHEN {fits[r]} THEN '{r.name}'" for r in ordered)
    said = " ".join(f"WHEN {fits[r]} THEN '{r.verdict}'" for r in ordered)
    href = url_filter.HREF.replace("'", "''")
    steps = []
    for done in range(1, url_filter.ROUNDS + 1):
        steps.append(f"""mass{done} AS MATERIALIZED (
  SELECT kind, host, cast(sum(mass) AS bigint) AS mass FROM (
    SELECT kind, s.target AS host, cast(floor(cast(m.mass AS double) * {url_filter.DAMPING}::double * s.share) AS bigint) AS mass
    FROM shares s JOIN mass{done - 1} m USING (kind, host)
    UNION ALL SELECT kind, host, cast(floor(cast(mass AS double) * (1.0::double - {url_filter.DAMPING}::double)) AS bigint) FROM mass0)
  GROUP BY ALL HAVING sum(mass) > 0)""")
    parents, ties = "hosts", []
    for up in range(3):
        ties.append(f"""above{up} AS (SELECT DISTINCT host AS src, regexp_replace(host, '^[^.]+\\.', '') AS dst FROM {parents}
  WHERE regexp_matches(host, '^[^.]+\\.[^.]+\\.'))""")
        parents = f"(SELECT DISTINCT dst AS host FROM above{up})"
    tied = " ".join(
        f"UNION ALL SELECT src, dst, {url_filter.DOMAIN_LINKS} FROM above{up} UNION ALL SELECT dst, src, {url_filter.DOMAIN_LINKS} FROM above{up}"
        for up in range(3)
    )
    return rf"""
WITH located AS (
  SELECT page_id, html, CASE WHEN rest IS NULL THEN '' ELSE translate(regexp_extract(rest, '^[^/?#]*'), {_A_Z}) END AS host,
         CASE WHEN rest IS NULL THEN '' ELSE regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') END AS path
  FROM (SELECT *, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages)),
ruled AS (SELECT page_id, host, path, CASE {name} END AS rule, CASE {said} END AS said FROM located),
seeds AS (SELECT CASE WHEN said = 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) AS weight
          FROM ruled WHERE said IS NOT NULL GROUP BY ALL),
linked AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{href}', 1)), {_A_Z}) AS dst FROM located),
hosts AS (SELECT host FROM located UNION SELECT dst FROM linked),
{", ".join(ties)},
edges AS (SELECT src, dst, cast(sum(links) AS bigint) AS links FROM (
  SELECT src, dst, count(*) AS links FROM linked GROUP BY ALL {tied}) WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY ALL),
ways AS (SELECT 'trust' AS kind, src AS host, dst AS target, links FROM edges
         UNION ALL SELECT 'distrust', dst, src, links FROM edges),
shares AS MATERIALIZED (SELECT kind, host, target, cast(links AS double) / cast(sum(links) OVER (PARTITION BY kind, host) AS double) AS share FROM ways),
mass0 AS MATERIALIZED (SELECT kind, host, cast(floor({float(url_filter.UNITS)!r}::double
  * (cast(weight AS double) / cast(sum(weight) OVER (PARTITION BY kind) AS double))) AS bigint) AS mass FROM seeds),
{", ".join(steps)},
final AS (SELECT host, cast(coalesce(sum(mass) FILTER (kind = 'trust'), 0) AS bigint) AS trust,
                 cast(coalesce(sum(mass) FILTER (kind = 'distrust'), 0) AS bigint) AS distrust FROM mass{url_filter.ROUNDS} GROUP BY ALL)
SELECT page_id, r.host, path, rule,
       coalesce(said, CASE WHEN cast(coalesce(distrust, 0) AS double)
         > {url_filter.DISTRUST_SHARE}::double * cast(coalesce(trust, 0) + coalesce(distrust, 0) AS double) THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
FROM ruled r LEFT JOIN final f ON f.host = r.host"""


_LEAK_SQL = rf"""
WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
tokens AS (SELECT kind, id, regexp_extract_all(translate(text, {_A_Z}), '[^\x20\x09-\x0D]+') AS w FROM texts),
shingled AS (SELECT DISTINCT kind, id, unnest(CASE WHEN len(w) <= {decontaminate.WORDS} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {decontaminate.WORDS - 2}), lambda i : array_to_string(w[i:i + {decontaminate.WORDS - 1}], ' ')) END) AS s
  FROM tokens WHERE len(w) > 0),
sets AS (SELECT id, count(*) AS n_shingles, string_agg(s, chr(10) ORDER BY s) AS content FROM shingled WHERE kind = 'i' GROUP BY id),
items AS (SELECT min(id) AS item_id, count(*) AS n_copies, min(n_shingles) AS n_shingles FROM sets GROUP BY content)
SELECT d.id AS doc_id, item_id, n_copies, count(*) AS n_shared, n_shingles,
       cast(count(*) AS double) / cast(n_shingles AS double) AS containment
FROM items i JOIN shingled x ON x.kind = 'i' AND x.id = i.item_id JOIN shingled d ON d.kind = 'd' AND d.s = x.s
GROUP BY d.id, item_id, n_copies, n_shingles
HAVING cast(count(*) AS double) / cast(n_shingles AS double) >= {decontaminate.LEAST_CONTAINMENT}::double"""


_LINES_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
placed AS (SELECT row, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM docs),
keyed AS (SELECT row, place, line, translate(regexp_replace(line, '^{_BLANKS}+|{_BLANKS}+$', '', 'g'), {_A_Z}) AS key FROM placed),
common AS (SELECT key FROM keyed WHERE length(key) >= {line_dedup.MIN_CHARS} GROUP BY key
           HAVING count(DISTINCT row) >= {line_dedup.MIN_DOCS}),
kept AS (SELECT row, string_agg(line, chr(10) ORDER BY place) AS text, count(*) AS n FROM keyed
         WHERE key NOT IN (SELECT key FROM common) GROUP BY row)
SELECT doc_id, cast(len(lines) AS bigint) AS n_lines, cast(len(lines) - coalesce(n, 0) AS bigint) AS n_dropped,
       sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (row)"""


def _mix_sql() -> str:
    weights = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(mixing.WEIGHTS))
    most, slices = mixing.MAX_COPIES, mixing.SLICES
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    upto = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return rf"""
WITH RECURSIVE
facts AS MATERIALIZED (SELECT doc_id, source, size, length(bin(size)) AS preference, digest,
    (cast('0x' || substr(digest, 1, 13) AS bigint) + 0.5::double) / {float(1 << 52)!r}::double AS u
  FROM (SELECT doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS bigint) AS size,
               md5(coalesce(cast(doc_id AS varchar), '') || '/' || coalesce(text, '')) AS digest FROM documents)),
classes AS (SELECT source, preference, cast(sum(size) AS bigint) AS size FROM facts GROUP BY ALL),
sizes AS (SELECT source, cast(sum(size) AS bigint) AS source_size FROM classes GROUP BY ALL),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} {weights} END AS weight FROM sizes),
ordered AS (SELECT *, row_number() OVER (ORDER BY cast(source_size AS double) / cast(weight AS double), source NULLS LAST) AS n FROM weighed),
stepped AS (SELECT *, cast({most} * source_size AS double) AS cap,
    cast(sum(source_size) OVER () - coalesce(sum({most} * source_size) OVER (ORDER BY n {before}), 0) AS double)
      / cast(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY n {before}), 0) AS double) AS level FROM ordered),
levels AS (SELECT min_by(level, n) AS level, min(n) AS n FROM stepped WHERE level * weight <= cap),
targets AS (SELECT source, source_size, CASE WHEN l.n IS NULL OR s.n < l.n THEN cap ELSE least(cap, l.level * weight) END AS target
            FROM stepped s, levels l),
factors AS (SELECT c.source, c.preference, c.size, source_size, target,
    row_number() OVER w AS n,
    CASE WHEN sum(c.preference * c.size) OVER (PARTITION BY c.source) - coalesce(sum(c.preference * c.size) OVER (w {before}), 0) > 0 THEN
      (target - cast(coalesce(sum(c.size) OVER (w {before}), 0) * {most} AS double))
      / cast(sum(c.preference * c.size) OVER (PARTITION BY c.source) - coalesce(sum(c.preference * c.size) OVER (w {before}), 0) AS double) END AS factor
  FROM classes c JOIN targets t ON t.source IS NOT DISTINCT FROM c.source
  WINDOW w AS (PARTITION BY c.source ORDER BY c.preference DESC)),
chosen AS (SELECT source AS s, min(n) AS n, min_by(factor, n) AS factor FROM factors WHERE factor * preference <= {float(most)} GROUP BY ALL),
expected AS (SELECT f.*, least({float(most)}::double, CASE WHEN c.n IS NULL OR f.n < c.n THEN {float(most)}::double ELSE c.factor * preference END) AS expected
  FROM factors f LEFT JOIN chosen c ON c.s IS NOT DISTINCT FROM f.source),
allotted AS (SELECT source, preference, size, source_size, target, cast(floor(expected) AS bigint) AS certain,
    expected - floor(expected) AS chance FROM expected),
open AS (SELECT source AS s, any_value(target) - cast(sum(size * certain) AS double) AS open FROM allotted GROUP BY ALL),
ranked AS MATERIALIZED (SELECT f.*, a.source_size, a.target, a.certain,
    CASE WHEN chance > 0 THEN ((u / (1.0::double - u)) * ((1.0::double - chance) / chance))
      / (1.0::double + (u / (1.0::double - u)) * ((1.0::double - chance) / chance)) END AS rank
  FROM facts f JOIN allotted a ON a.source IS NOT DISTINCT FROM f.source AND a.preference = f.preference),
sliced AS MATERIALIZED (SELECT *, cast(floor(rank * {slices}) AS integer) AS slice FROM ranked),
running AS (SELECT source, slice, sum(sum(size)) OVER (PARTITION BY source ORDER BY slice) AS until, sum(size) AS words
  FROM sliced WHERE rank IS NOT NULL GROUP BY source, slice),
crossing AS (SELECT s, slice AS last_slice, open - cast(until - words AS double) AS room
  FROM running r JOIN open o ON o.s IS NOT DISTINCT FROM r.source WHERE until - words < open AND until >= open),
inside AS (SELECT source, rank, digest, room, sum(size) OVER (PARTITION BY source ORDER BY rank, digest {upto}) AS filled
  FROM sliced JOIN crossing ON s IS NOT DISTINCT FROM source AND slice = last_slice),
cuts AS (SELECT source AS c, max(struct_pack(rank, digest)) AS cut, max(filled) AS filled FROM inside WHERE filled <= room GROUP BY ALL),
ends AS (SELECT s, last_slice, cut, room - cast(coalesce(filled, 0) AS double) AS gap
  FROM crossing LEFT JOIN cuts ON c IS NOT DISTINCT FROM s),
fitted AS MATERIALIZED (SELECT x.*, last_slice, gap,
    slice < last_slice OR (slice = last_slice AND coalesce(struct_pack(rank := x.rank, digest := x.digest) <= cut, false)) AS fits
  FROM sliced x LEFT JOIN ends ON s IS NOT DISTINCT FROM source),
lots AS (SELECT source, gap, min(struct_pack(rank := rank, digest := digest, size := size)) AS one
  FROM fitted WHERE rank IS NOT NULL AND last_slice IS NOT NULL AND NOT fits AND size > 0
  GROUP BY source, gap, length(bin(size)), substr(digest, 14, 1)),
fillers AS (SELECT source, gap, one.size AS size, one.digest AS digest,
    row_number() OVER (PARTITION BY source ORDER BY one.size DESC, one.digest) AS n FROM lots),
fill AS (
  SELECT source, n, digest, size <= gap AS taken, CASE WHEN size <= gap THEN gap - size ELSE gap END AS gap FROM fillers WHERE n = 1
  UNION ALL
  SELECT f.source, f.n, f.digest, f.size <= p.gap, CASE WHEN f.size <= p.gap THEN p.gap - f.size ELSE p.gap END
  FROM fill p JOIN fillers f ON f.source IS NOT DISTINCT FROM p.source AND f.n = p.n + 1)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM (
  SELECT *, certain + CASE WHEN rank IS NOT NULL AND (last_slice IS NULL OR fits
      OR digest IN (SELECT digest FROM fill WHERE taken)) THEN 1 ELSE 0 END AS copies FROM fitted)"""


def _shard_sql() -> str:
    filled = ",".join(map(str, sharding.fill_slots(SHARDS)))
    return f"""
WITH slots AS (SELECT unnest(range({sharding.SLOTS})) AS slot, unnest(string_split('{filled}', ',')) AS shard)
SELECT doc_id, cast(slot AS integer) AS slot, cast(shard AS integer) AS shard
FROM (SELECT doc_id, cast('0x' || substr(md5(coalesce(cast(doc_id AS varchar), '')), 1, 15) AS bigint) % {sharding.SLOTS} AS slot FROM documents)
JOIN slots USING (slot)"""


_MIDDLE_SQL = rf"""
WITH cut AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_BLANKS}*[^\x20\x09-\x0D]+|{_BLANKS}+') AS units,
    sha256('42:' || coalesce(cast(doc_id AS varchar), '')) AS h FROM documents),
drawn AS (SELECT *, len(units) AS n, cast('0x' || substr(h, 1, 8) AS bigint) % (len(units) + 1) AS x,
    cast('0x' || substr(h, 9, 8) AS bigint) % (len(units) + 1) AS y,
    cast('0x' || substr(h, 17, 8) AS bigint) % 100 AS shown, cast('0x' || substr(h, 25, 8) AS bigint) % 100 AS turned FROM cut),
parted AS (SELECT *, coalesce(array_to_string(units[1:least(x, y)], ''), '') AS prefix,
    coalesce(array_to_string(units[least(x, y) + 1:greatest(x, y)], ''), '') AS middle,
    coalesce(array_to_string(units[greatest(x, y) + 1:], ''), '') AS suffix,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR shown >= 50 THEN 'plain'
         WHEN turned < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
joined AS (SELECT *, CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END AS output FROM parted),
found AS (SELECT *, instr(output, '<P>') AS p, instr(output, '<S>') AS s, instr(output, '<M>') AS m FROM joined)
SELECT doc_id, cast(n AS bigint) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars, sha256(output) AS output_sha256,
       sha256(CASE form WHEN 'psm' THEN substr(output, p + 3, s - p - 3) || substr(output, m + 3) || substr(output, s + 3, m - s - 3)
                        WHEN 'spm' THEN substr(output, p + 3, m - p - 3) || substr(output, m + 3) || substr(output, s + 3, p - s - 3)
                        ELSE output END) AS restored_sha256
FROM found"""


ORACLES = {
    "op2_decontamination": _LEAK_SQL,
    "op4_url_filter": _url_sql(),
    "op7_line_dedup": _LINES_SQL,
    "op9_mixing": _mix_sql(),
    "op10_sharding": _shard_sql(),
    "op12_fill_in_middle": _MIDDLE_SQL,
}
