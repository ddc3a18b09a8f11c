"""Registered queries of the package and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm import bottomk, jaccard, kdtree, line_dedup, merkle, mixing, periodic, perplexity, pieces, quality, shards, token_counts, warc
from loomlog.session import configure


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


N_SHARDS = 40


def op1_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of 10 shards, racks of 5; the next shard opens a region of its own."""
    placed = shards.place(table(spark, sf_dir, "documents"), shards.even_tree(N_SHARDS), shards.even_tree(N_SHARDS + 1))
    return placed.withColumn("law", F.lit("key"))


def op2_mix_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows, sizes, goal = mixing.mix(docs, F.array("source"), ["doc_id", "source"])
    # At most MAX_PATTERNS rows, else mix() has refused.
    known = spark.createDataFrame([(s, sizes[s], goal[s]) for s in sizes], "name string, source_size long, target double")
    met = rows.join(F.broadcast(known), F.col("row.source").eqNullSafe(F.col("name")))
    return met.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op3_kd_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are learnt only where crc32 of the id's digits leaves another remainder than 1 by 3."""
    fold = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 3
    scored = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold != 1)
    return scored.select("doc_id", (fold == 1).alias("held_out"), "score", "predicted")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.drop_common_lines(docs, min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op6_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = perplexity.judge(table(spark, sf_dir, "documents"), ["doc_id"], stored=True)
    return judged.select("row.doc_id", *perplexity.COUNTS, "base_failed", "kept", "perplexity")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"), words=3, percent=90)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def op9_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.encode(F.array_join(F.col("ids").cast("array<string>"), ","), "UTF-8"), 256).alias("ids_sha256"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    streams, members = warc.archive_folders(configure(spark))
    files = warc.write_archives(table(spark, sf_dir, "pages"), streams, min_bytes=0)
    records = warc.read_records(warc.normalise(files, members), members)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def id_crc32() -> F.Column:
    """The unsigned checksum of the id's digits; null for a null id."""
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(table(spark, sf_dir, "documents"), seed=id_crc32(), change=periodic.repeat_tail)
    rank = F.expr("array_sort(runs, (x, y) -> case when x.length <> y.length then cast(sign(y.length - x.length) as int) "
                  "when x.start <> y.start then cast(sign(x.start - y.start) as int) else cast(sign(x.period - y.period) as int) end)")
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    best = found.withColumn("best", F.get(rank, F.lit(0)))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), merkle.hashed(listed).alias("runs_sha256"),
        merkle.hashed(F.col("collapsed")).alias("collapsed_sha256"),
    )


def op12_slot_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(id_crc32() % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    rows = merkle.manifest(table(spark, sf_dir, "documents"), tampered)
    folded = rows.withColumn("folded_root", merkle.fold(F.col("other"), F.col("path")))
    return folded.select(
        "doc_id", merkle.hex_of(F.col("digest")).alias("leaf"), "subroot", "root", merkle.hashed(merkle.proof(F.col("path"))).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk.link(table(spark, sf_dir, "documents"), words=5, percent=85)


QUERIES = {
    "op1_hash_tree": op1_hash_tree,
    "op2_mix_flow": op2_mix_flow,
    "op3_kd_search": op3_kd_search,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_line_dedup": op5_line_dedup,
    "op6_perplexity_rules": op6_perplexity_rules,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_token_counts": op8_token_counts,
    "op9_sentence_pieces": op9_sentence_pieces,
    "op10_warc": op10_warc,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_slot_pivot": op12_slot_pivot,
    "op13_bottom_k": op13_bottom_k,
}


def _draw(level: str, children: str) -> str:
    """The child with the smallest weighted draw, in SQL."""
    hashed = f"md5('0|{level}|' || child || '|' || key)"
    return f"""
      select r, arg_min(child, -ln((('0x' || substr({hashed}, 1, 13))::bigint::double + 0.5) / 4503599627370496.0) / weight)
      from {children} group by r"""


def _placed(n: int, name: str) -> str:
    return f"""
    leaf{n} as (select s as shard, s // 5 as rack, s // 10 as region from range({n}) t(s)),
    region{n}(r, region) as ({_draw("region", f"(select d.r, d.key, c.region as child, c.weight::double as weight from d, (select region, count(*) as weight from leaf{n} group by 1) c)")}),
    rack{n}(r, rack) as ({_draw("rack", f"(select d.r, d.key, c.rack as child, c.weight::double as weight from d join region{n} using (r) join (select region, rack, count(*) as weight from leaf{n} group by 1, 2) c using (region))")}),
    {name}(r, shard) as ({_draw("shard", f"(select d.r, d.key, c.shard as child, 1.0::double as weight from d join rack{n} using (r) join leaf{n} c using (rack))")})"""


# The checksum's table of 256 entries follows from its polynomial 0xEDB88320.
_CRC_TABLE = """
with recursive bits(i, k, c) as (
  select i, 0, i::bigint from range(256) t(i)
  union all
  select i, k + 1, case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end from bits where k < 8
),
crc_table as (select list(c order by i) as t from bits where k = 8)"""


def _crc32(text: str) -> str:
    """The unsigned checksum of a text that is not null; needs ``crc_table`` beside it."""
    return f"""xor(list_reduce(
      list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::bigint)),
      lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])
    ), 4294967295)"""


OP1_SQL = f"""{_CRC_TABLE},
d as (
  select row_number() over () as r, doc_id, coalesce(doc_id::varchar, 'null') as key, octet_length(encode(coalesce(text, ''))) + 16 as size,
    {_crc32("coalesce(text, '')")} as text_crc32
  from documents, crc_table
),
{_placed(N_SHARDS, "now")},
{_placed(N_SHARDS + 1, "later")}
select doc_id, size, text_crc32, 'key' as law, now.shard::int as shard, later.shard::int as grown_shard,
  row_number() over (
    partition by now.shard
    order by substr(md5('slot|' || key || '|' || text_crc32 || '|' || size), 1, 3), doc_id nulls first, size, text_crc32
  ) - 1 as slot
from d join now using (r) join later using (r)
"""

OP3_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings
  where vec_id is not null and embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
),
s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::bigint as score
  from (select distinct vec_id, e from v where vec_id % 50 = 0) q join v c on c.vec_id <> q.vec_id and len(c.e) = len(q.e)
)
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5
"""

OP5_SQL = r"""
with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (
  select r, unnest(range(len(lines))) as pos, unnest(lines) as line from d
),
k as (
  select r, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l
),
common as (select key from k where length(key) >= 1 group by key having count(distinct r) >= 10),
kept as (
  select r, string_agg(line, chr(10) order by pos) as text, count(*) as n
  from k where key not in (select key from common) group by r
)
select doc_id, len(lines) as n_lines, len(lines) - coalesce(n, 0) as n_dropped, sha256(coalesce(text, '')) as kept_sha256
from d left join kept using (r)
"""

def _near(words: int, percent: int, more: str = "") -> str:
    """Components of documents whose sets of word shingles are near; OP7 and OP13."""
    joined = " || ' ' || ".join(f"w[i + {k}]" for k in range(words))
    return rf"""
with recursive d as (
  select row_number() over () as r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
),
s as (
  select r, doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < {words} then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - {words - 2}), lambda i: {joined}) end) as shingles from d
),
t as (select r, len(shingles) as n, unnest(shingles) as shingle from s),
e as (
  select x.r as a, y.r as b from t x join t y on x.shingle = y.shingle and x.r <> y.r
  group by x.r, y.r, x.n, y.n having 100 * count(*) >= {percent} * (x.n + y.n - count(*))
),
reach(r, z) as (select r, r from s union select e.b, reach.z from reach join e on reach.r = e.a)
select s.doc_id, len(s.shingles) as n_shingles, min(o.doc_id) as component_id{more}
from reach join s using (r) join s o on o.r = reach.z group by s.r, s.doc_id, s.shingles
"""


OP7_SQL = _near(3, 90)
OP13_SQL = _near(5, 85, ", s.doc_id is not distinct from min(o.doc_id) as kept")

OP10_SQL = """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages),
b as (
  select page_id, octet_length(encode(html)) as payload_bytes, hex,
    min(page_id) over (partition by html) as first_id,
    list_transform(range(8), lambda i: ('0x' || substr(hex, 5 * i + 1, 5))::bigint) as parts
  from p
)
select page_id, payload_bytes,
  list_aggregate(flatten(list_transform(parts, lambda x: list_transform([32768, 1024, 32, 1],
    lambda y: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x // y) % 32 + 1)::int, 1)))), 'string_agg', '') as payload_digest,
  case when first_id is null or page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id = first_id then null else first_id end as refers_to
from b
"""

_ID_CRC32 = f"case when doc_id is not null then {_crc32("coalesce(doc_id::varchar, '')")} end"

OP11_SQL = rf"""{_CRC_TABLE},
d as (
  select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w, {_ID_CRC32} as h
  from documents, crc_table
),
s as (
  select *, len(w) as n, (h // 10) % nullif(len(w), 0) as a, 1 + (len(w) - (h // 10) % nullif(len(w), 0)) // (3 + (h // 10) % 8) as p from d
),
m as (
  select r, doc_id, n, case when n > 0 and h % 10 = 0 then list_transform(range(n), lambda i: w[case when i < a then i else a + (i - a) % p end + 1]) else w end as w
  from s
),
g as (
  select r, n, unnest(range(n - 4)) as i,
    unnest(list_transform(range(n - 4), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] || ' ' || w[i + 5])) as shingle
  from m where n >= 6
),
pairs as (
  select x.r, x.i, y.i - x.i as q from g x join g y on x.r = y.r and x.shingle = y.shingle and x.i < y.i where 4 * (y.i - x.i) <= x.n
),
islands as (select r, q, i, i - row_number() over (partition by r, q order by i) as island from pairs),
repeats as (select r, q, min(i) as start, count(*) + 4 + q as length from islands group by r, q, island having count(*) + 4 + q >= greatest(6, 4 * q)),
runs as (select r, start, length, min(q) as period from repeats group by r, start, length),
listed as (
  select r, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as txt,
    first({{'start': start, 'length': length, 'period': period}} order by length desc, start, period) as best
  from runs group by r
),
gone as (select distinct r, unnest(range(start + period, start + length)) as i from runs),
words as (select r, unnest(range(n)) as i, unnest(w) as word from m where r in (select r from runs)),
kept as (select r, string_agg(word, ' ' order by i) as txt from words anti join gone using (r, i) group by r)
select doc_id, coalesce(n_runs, 0) as n_runs, best.start as start, best.length as length, best.period as period,
  1000 * best.length // best.period as exponent_milli, sha256(coalesce(listed.txt, '')) as runs_sha256,
  sha256(case when n_runs is null then array_to_string(w, ' ') else coalesce(kept.txt, '') end) as collapsed_sha256
from m left join listed using (r) left join kept using (r)
"""


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::varchar)) || ':' || {value}::varchar, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


OP12_SQL = f"""{_CRC_TABLE},
d as (
  select row_number() over () as r, doc_id, source, {_leaf("text")} as leaf,
    {_leaf(f"(case when ({_ID_CRC32}) % 2 = 0 then replace(text, chr(10), '') else text end)")} as other
  from documents, crc_table
),
l as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf, r) - 1 as pos, count(*) over (partition by source) as n from d
),
up(level, source, pos, n, h) as (
  select 0, source, pos, n, leaf from l
  union all
  select level + 1, source, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' order by pos)) from up where n > 1 group by level, source, pos // 3, n
),
subroots as (select source, h, row_number() over (order by source nulls first) - 1 as pos, count(*) over () as n from up where n = 1),
top(level, pos, n, h) as (
  select 0, pos, n, h from subroots
  union all
  select level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' order by pos)) from top where n > 1 group by level, pos // 3, n
),
nodes as (select level, source, 0 as upper, pos, n, h from up union all select level, null, 1, pos, n, h from top),
siblings as (
  select level, source, upper, pos, n,
    coalesce(string_agg(h, '') over (partition by level, source, upper, pos // 3 order by pos rows between unbounded preceding and 1 preceding), '') as before,
    coalesce(string_agg(h, '') over (partition by level, source, upper, pos // 3 order by pos rows between 1 following and unbounded following), '') as after
  from nodes
),
walk(r, level, source, pos, n, h, proof) as (
  select r, 0, source, pos, n, other, '' from l
  union all
  select r, w.level + 1, w.source, w.pos // 3, (w.n + 2) // 3, sha256(before || h || after), proof || before || after
  from walk w join siblings s on s.upper = 0 and s.level = w.level and s.source is not distinct from w.source and s.pos = w.pos where w.n > 1
),
climb(r, level, pos, n, h, proof) as (
  select w.r, 0, s.pos, s.n, w.h, w.proof from walk w join subroots s on s.source is not distinct from w.source where w.n = 1
  union all
  select r, c.level + 1, c.pos // 3, (c.n + 2) // 3, sha256(before || h || after), proof || before || after
  from climb c join siblings s on s.upper = 1 and s.level = c.level and s.pos = c.pos where c.n > 1
)
select l.doc_id, l.leaf, s.h as subroot, t.h as root, sha256(c.proof) as proof_sha256, c.h as folded_root, c.h = t.h as verified
from l join subroots s on s.source is not distinct from l.source join climb c on c.r = l.r and c.n = 1, (select h from top where n = 1) t
"""

ORACLES = {"op1_hash_tree": OP1_SQL, "op3_kd_search": OP3_SQL, "op5_line_dedup": OP5_SQL, "op7_jaccard_join": OP7_SQL, "op10_warc": OP10_SQL, "op11_periodic_runs": OP11_SQL, "op12_slot_pivot": OP12_SQL, "op13_bottom_k": OP13_SQL}
