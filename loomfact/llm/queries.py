"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import aligned
from .chat_repair import repairs
from .common import documents, table
from .embedding_dedup import linked
from .exact_dedup import exact_groups
from .packing import pack
from .pieces import decode, encode
from .quality import graded
from .secrets import scan
from .sharding import LIMIT_BYTES, shards
from .simhash import near_groups
from .token_files import round_trip
from .tool_calls import linked as linked_calls
from .voronoi import top_k


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(documents(spark, sf_dir))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(documents(spark, sf_dir))


OP2_SQL = f"""
WITH h AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes,
         lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(1) || md5(coalesce(text, ''))), 1, 12))::BIGINT), 48, '0') AS bits
  FROM documents),
k AS (SELECT h.*, substr(bits, 1, d) AS prefix, d FROM h CROSS JOIN generate_series(0, 40) AS g(d)),
s AS (SELECT d, prefix, sum(n_bytes) AS b, count(*) AS n FROM k GROUP BY d, prefix),
l AS (SELECT k.doc_id, min(s.d) AS depth FROM k JOIN s USING (d, prefix) WHERE s.b <= {LIMIT_BYTES} OR s.n = 1 GROUP BY k.doc_id)
SELECT doc_id, n_bytes, substr(bits, 1, depth) AS shard, depth, n_bytes > {LIMIT_BYTES} AS oversize FROM h JOIN l USING (doc_id)
"""


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = round_trip(documents(spark, sf_dir))
    return docs.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "embeddings"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


#: The tool of :func:`with_calls` and the schema of its arguments.
MEASURE = {"measure": {"type": "object", "properties": {"chars": {"type": "integer"}, "after": {"type": "string"}}, "required": ["chars"], "additionalProperties": False}}


def with_calls(conversations: DataFrame) -> DataFrame:
    """Chats in which every assistant's message calls a tool, as the table itself has no calls.

    The call tells the message's length, and needs the call of two turns before. So that
    all branches of the operator have rows: by the length, a tenth call an unknown tool, a
    seventh break the schema, an eleventh need themselves, and a fifth get no result.
    Turns are doubled; a result stands between its call and the next message.
    """
    n = F.coalesce(F.char_length("text"), F.lit(0))
    turn = F.col("turn").cast("string")
    own = F.concat(F.lit("c"), turn)
    after = F.concat(F.lit("$c"), F.when(n % 11 == 0, F.col("turn")).otherwise(F.col("turn") - 2).cast("string"))
    chars = F.when(n % 7 == 0, '"many"').otherwise(n.cast("string"))
    arguments = F.concat(F.lit('{"after":"'), after, F.lit('","chars":'), chars, F.lit("}"))
    call = F.struct(own.alias("id"), F.when(n % 10 == 0, "lost").otherwise("measure").alias("name"), arguments.alias("arguments"))
    asked = F.to_json(F.struct(F.col("text").alias("content"), F.array(call).alias("tool_calls")))
    speaks = F.coalesce(F.col("role") == "assistant", F.lit(False)) & F.col("turn").isNotNull()
    rows = conversations.select("conv_id", (F.col("turn") * 2).alias("turn"), "role", F.when(speaks, asked).otherwise(F.col("text")).alias("text"))
    answer = F.to_json(F.struct(own.alias("tool_call_id"), F.struct(n.alias("chars")).alias("content")))
    results = conversations.where(speaks & (n % 5 != 0)).select("conv_id", (F.col("turn") * 2 + 1).alias("turn"), F.lit("tool").alias("role"), answer.alias("text"))
    return rows.union(results)


def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linked_calls(with_calls(table(spark, sf_dir, "conversations")), MEASURE)
    return rows.fillna({"call_id": "", "level": 0, "linked": False, "error": ""})


OP7_SQL = """
WITH RECURSIVE b AS (SELECT conv_id, turn, role, text, coalesce(length(text), 0) AS n FROM conversations),
c AS (SELECT conv_id, turn, n, text, 'c' || turn AS id, CASE WHEN n % 10 = 0 THEN 'lost' ELSE 'measure' END AS name, 'c' || (CASE WHEN n % 11 = 0 THEN turn ELSE turn - 2 END) AS need,
             CASE WHEN n % 7 = 0 THEN '"many"' ELSE n::VARCHAR END AS chars FROM b WHERE role = 'assistant' AND turn IS NOT NULL),
d AS (SELECT *, '{"arguments":{"after":"$' || need || '","chars":' || chars || '},"id":"' || id || '","name":"' || name || '"}' AS body,
             CASE WHEN name = 'lost' THEN 'unknown tool' WHEN n % 7 = 0 THEN 'arguments.chars: not integer' ELSE '' END AS error FROM c),
lv(conv_id, id, level) AS (SELECT d.conv_id, d.id, 1::BIGINT FROM d LEFT JOIN d e ON e.conv_id = d.conv_id AND e.id = d.need WHERE e.id IS NULL
  UNION ALL SELECT d.conv_id, d.id, lv.level + 1 FROM d JOIN lv ON lv.conv_id = d.conv_id AND lv.id = d.need),
k AS (SELECT d.*, coalesce(lv.level, 0) AS level, '{"content":{"chars":' || n || '},"role":"tool","tool_call_id":"' || d.id || '"}' AS answer FROM d LEFT JOIN lv USING (conv_id, id))
SELECT conv_id, turn * 2 AS turn, role, 'message' AS kind, 0::BIGINT AS pos, '' AS call_id, 0::BIGINT AS level, false AS linked, '' AS error,
       '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || CASE WHEN role = 'assistant' AND turn IS NOT NULL THEN ',"tool_calls":["c' || turn || '"]' ELSE '' END || '}' AS json FROM b
UNION ALL SELECT conv_id, turn * 2, 'assistant', 'call', 0, id, level, n % 5 <> 0, CASE WHEN error <> '' THEN error WHEN level = 0 THEN 'circular' ELSE '' END,
       CASE WHEN n % 5 <> 0 THEN '{"call":' || body || ',"result":' || answer || '}' ELSE body END FROM k
UNION ALL SELECT conv_id, turn * 2 + 1, 'tool', 'result', 0, id, 0, true, '', answer FROM k WHERE n % 5 <> 0
"""


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = decode(encode(documents(spark, sf_dir)))
    return back.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graded(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op11_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP11_SQL = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, d.vec_id, d.rid AS other, list_dot_product(q.v, d.v)::BIGINT AS score FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.rid <> d.rid)
SELECT query_id, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id, other)::INTEGER AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id, other) <= 20
"""


def damaged(conversations: DataFrame) -> DataFrame:
    """Chats with faults planted by ``crc32("conv_id:turn") % 20``: a turn is dropped, emptied, broken off, repeated or made the user's."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind, text, role = F.crc32(key.cast("binary")) % 20, F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    times = F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = conversations.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.explode(times).alias("copy"))
    return rows.drop("copy")


def op12_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = repairs(damaged(rows)).withColumnRenamed("conv_id", "conv")
    every = rows.select("conv_id").distinct()
    nothing = {c: 0 for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return every.join(found, every.conv_id.eqNullSafe(F.col("conv")), "left").drop("conv").fillna(nothing, list(nothing))


def _op12_sql() -> str:
    """The same edits turn by turn in a recursive query: for each state (nothing, s, u or a last) the least cost, audit and turns."""
    crc = "list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(key, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"

    def edit(state: str, letter: str, cost: str, turn: str = "", if_: str = "true") -> str:
        turns = f"list_append({state}.turns, {turn})" if turn else f"{state}.turns"
        return f"CASE WHEN {state} IS NOT NULL AND ({if_}) THEN {{'cost': {state}.cost + {cost}, 'audit': {state}.audit || {letter}, 'turns': {turns}}} END"

    def least(*options: str) -> str:
        return f"list_min([{', '.join(options)}])"

    stay = "5 * r.broken::INT"
    own = "r.role || ':' || r.text"
    keep_or = lambda s, c, role: edit(s, f"CASE WHEN r.role[1] = '{c}' THEN 'K' ELSE 'R' END", f"{stay} + (r.role[1] <> '{c}')::INT", f"CASE WHEN r.role[1] = '{c}' THEN {own} ELSE '{role}:' || r.text END", "NOT r.must")  # noqa: E731
    return rf"""
WITH RECURSIVE b AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
k AS (SELECT *, xor({crc}, 4294967295) % 20 AS kind FROM b),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
             unnest(CASE WHEN kind = 0 THEN []::INT[] WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM k),
e AS (SELECT *, NOT regexp_matches(text, '[^ 	-]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
             NOT regexp_matches(text, '[.!?][ 	-]*\z') AS cut FROM d),
f AS (SELECT *, NOT blank AND again AS dup, NOT blank AND NOT again AND cut AS broken FROM e),
o AS (SELECT *, row_number() OVER w AS i, lag(role[1]) OVER w || role[1] AS pair FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INT)::BIGINT AS blank, sum(dup::INT)::BIGINT AS duplicate, sum(broken::INT)::BIGINT AS truncated,
             count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal, list({{'role': role, 'text': text, 'must': blank OR dup, 'broken': broken}} ORDER BY i) AS rows FROM o GROUP BY conv_id),
z AS (SELECT 1 AS one, {{'cost': 0, 'audit': '', 'turns': []::VARCHAR[]}} AS nothing),
p(conv_id, i, rows, s0, s1, s2, s3) AS (
  SELECT conv_id, 0, rows, nothing, CASE WHEN false THEN nothing END, CASE WHEN false THEN nothing END, CASE WHEN false THEN nothing END FROM g, z
  UNION ALL
  SELECT conv_id, i + 1, rows, {edit("s0", "'D'", "2")}, {least(edit("s1", "'D'", "2"), edit("s0", "'K'", stay, own, "NOT r.must AND r.role[1] = 's'"))},
         {least(edit("t2", "'D'", "2"), keep_or("s0", "u", "user"), keep_or("s1", "u", "user"), keep_or("t3", "u", "user"))},
         {least(edit("t3", "'D'", "2"), keep_or("t2", "a", "assistant"))}
  FROM (SELECT *, {least("s3", edit("t2", "'I'", "5", "'assistant:'"))} AS t3, rows[i + 1] AS r
        FROM (SELECT *, {least("s2", *[edit(s, "'I'", "5", "'user:'") for s in ("s0", "s1", "s3")])} AS t2 FROM p WHERE i < len(rows)))),
l AS (SELECT conv_id, {least("s0", "s3", edit("t2", "'I'", "5", "'assistant:'"))} AS best
      FROM (SELECT *, {least("s2", edit("s1", "'I'", "5", "'user:'"))} AS t2 FROM p WHERE i = len(rows)))
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.turns, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN l ON l.conv_id IS NOT DISTINCT FROM c.conv_id
"""


OP12_SQL = _op12_sql()


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(documents(spark, sf_dir))


OP6_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_sharding": op2_sharding,
        "op3_secrets": op3_secrets,
        "op4_token_files": op4_token_files,
        "op5_embedding_dedup": op5_embedding_dedup,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_tool_calls": op7_tool_calls,
        "op8_pieces": op8_pieces,
        "op9_simhash": op9_simhash,
        "op10_quality": op10_quality,
        "op11_top_k": op11_top_k,
        "op12_chat_repair": op12_chat_repair,
        "op13_alignment": op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_sharding": OP2_SQL,
        "op6_exact_dedup": OP6_SQL,
        "op7_tool_calls": OP7_SQL,
        "op11_top_k": OP11_SQL,
        "op12_chat_repair": OP12_SQL,
    }
