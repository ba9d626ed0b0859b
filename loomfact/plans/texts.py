"""Text processing and retrieval over documents, conversations, benchmark passages and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import induce, retrieval, search
from ..registry import Tables, query


@query("dialogue_share", """SELECT doc_id, CASE WHEN n = 0 THEN 0 ELSE m * 10000 // n END AS share FROM (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')) AS n,
len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '' AND substr(regexp_replace(x, '^\\s+', ''), 1, 1) IN ('"', '“', '「', '『'))) AS m FROM documents)""")
def dialogue_share(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.dialogue_share(F.col("text")).alias("share"))


_NOISE_CASE = "CASE " + " ".join(f"WHEN regexp_matches(line, '{p}') THEN '{k}'" for k, p, _ in tx.NOISE) + " END"
_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"


@query("noise_lines", f"WITH {_LINES} SELECT doc_id, line_no, kind FROM (SELECT *, {_NOISE_CASE} AS kind FROM l) WHERE kind IS NOT NULL")
def noise_lines(t: Tables) -> DataFrame:
    rows = tx.lines(t.documents, "doc_id", "text").withColumn("kind", tx.noise_kind(F.col("line")))
    return rows.where("kind is not null").select("doc_id", F.col("line_no").cast("long").alias("line_no"), "kind")


@query("noise_report", f"WITH {_LINES} SELECT kind, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT *, {_NOISE_CASE} AS kind FROM l) WHERE kind IS NOT NULL GROUP BY kind")
def noise_report(t: Tables) -> DataFrame:
    return noise_lines(t).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query(
    "clean_texts",
    f"""WITH {_LINES}, k AS (SELECT *, CASE WHEN kind IN ('url', 'promo', 'contact', 'template') THEN 1 ELSE 0 END AS gone FROM (SELECT *, {_NOISE_CASE} AS kind FROM l))
SELECT doc_id, sum(gone)::BIGINT AS removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE gone = 0), '')) AS hash FROM k GROUP BY doc_id""",
)
def clean_texts(t: Tables) -> DataFrame:
    out = tx.cleaned(t.documents.select("doc_id", "text"), "doc_id", "text")
    return out.select("doc_id", "removed", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))


@query("repeated_lines", f"WITH {_LINES} SELECT md5(line) AS line, count(DISTINCT doc_id) AS docs FROM l WHERE trim(line, ' ') <> '' GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3")
def repeated_lines(t: Tables) -> DataFrame:
    rows = tx.lines(t.documents, "doc_id", "text").where(F.trim("line") != "")
    hashed = rows.select("doc_id", F.md5(F.col("line").cast("binary")).alias("line")).distinct()
    return hashed.groupBy("line").agg(F.count("*").alias("docs")).where("docs >= 3")


@query(
    "repeated_tails",
    f"""WITH d AS (SELECT source, doc_id, text FROM documents), l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d),
s AS (SELECT source, count(DISTINCT doc_id) AS m FROM l GROUP BY source HAVING count(DISTINCT doc_id) >= 4),
f AS (SELECT *, row_number() OVER (PARTITION BY source, doc_id ORDER BY k DESC) AS j FROM l WHERE trim(line, ' ') <> ''),
n AS (SELECT source, line, count(DISTINCT doc_id) AS n FROM f WHERE j <= 5 GROUP BY ALL) SELECT source, md5(line) AS line, n FROM n JOIN s USING (source) WHERE n >= 0.02 * m""",
)
def repeated_tails(t: Tables) -> DataFrame:
    from ..operators.sequence import repeated_tails as tails

    rows = t.documents.select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    out = tails(rows, ["doc_id"], "k", "line", ["source"], share=0.02)
    return out.select("source", F.md5(F.col("line").cast("binary")).alias("line"), "n")


@query(
    "section_classes",
    """WITH a AS (SELECT doc_id, source, text, string_split(text, chr(10))[1] AS title, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place, count(*) OVER (PARTITION BY source) AS total FROM documents),
b AS (SELECT *, contains(lower(text), 'licensed')::INT + contains(lower(text), 'isbn')::INT + contains(lower(text), 'edition')::INT + contains(lower(text), 'publisher')::INT AS pub,
 contains(lower(text), 'critic')::INT + contains(lower(text), 'scholar')::INT + contains(lower(text), 'translation')::INT AS crit, place <= 2 OR place > total - 2 AS edge FROM a)
SELECT doc_id, CASE WHEN regexp_matches(lower(title), '^(preface|foreword|appendix|copyright|postscript)') THEN 'title' WHEN pub >= 2 THEN 'publishing' WHEN place = 1 AND length(text) < 200 THEN 'short_prologue'
 WHEN edge AND regexp_matches(lower(title), 'author|acknowledg') THEN 'boundary_title' WHEN crit >= 3 THEN 'criticism' WHEN edge AND length(text) < 300 THEN 'short_boundary' ELSE 'story' END AS class FROM b""",
)
def section_classes(t: Tables) -> DataFrame:
    """A source is a book and a document a section; places come from the ids alone, texts are not shuffled twice."""
    w = W.partitionBy("source")
    rows = t.documents.select("doc_id", "source", "text")
    place = rows.select("doc_id", "source").withColumn("place", F.row_number().over(w.orderBy("doc_id"))).withColumn("total", F.count("*").over(w))
    both = rows.drop("source").join(place, "doc_id")
    return both.select("doc_id", tx.section_class(F.split("text", "\n")[0], F.col("text"), F.col("place"), F.col("total")).alias("class"))


@query(
    "ngram_counts",
    """WITH r AS (SELECT item_id, unnest(regexp_extract_all(text, '([a-z]{2,})', 1)) AS run FROM benchmark), g AS (SELECT item_id, substr(run, i::INT, n::INT) AS gram FROM r, generate_series(2, 4) a(n), generate_series(1, 40) b(i) WHERE i + n - 1 <= length(run))
SELECT gram, count(*) AS n, count(DISTINCT item_id) AS docs FROM g GROUP BY gram HAVING count(*) >= 5""",
)
def ngram_counts(t: Tables) -> DataFrame:
    rows = tx.grams(t.benchmark, "item_id", "text", "[a-z]{2,}", 2, 4)
    return rows.groupBy("gram").agg(F.count("*").alias("n"), F.countDistinct("item_id").alias("docs")).where("n >= 5")


@query("word_frequency", r"SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,8}')) AS word FROM documents) GROUP BY word HAVING count(*) >= 20")
def word_frequency(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,8})"), F.lit(1))).alias("word"))
    once = rows.groupBy("doc_id", "word").agg(F.count("*").alias("c"))
    return once.groupBy("word").agg(F.sum("c").alias("n"), F.count("*").alias("docs")).where("n >= 20")


@query("naming_patterns", r"SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '(?:the|der|les|los) ([a-zà-ÿ]{4,}) (?:of|and|und|et|y)\b', 1)) AS name FROM documents) GROUP BY name")
def naming_patterns(t: Tables) -> DataFrame:
    """Names by the words around them; word boundaries are ASCII on both sides."""
    found = F.regexp_extract_all("text", F.lit(r"(?:the|der|les|los) ([a-zà-ÿ]{4,}) (?:of|and|und|et|y)(?![A-Za-z0-9_])"), F.lit(1))
    return t.documents.select(F.explode(found).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


@query("search_chapters", "SELECT doc_id, CASE WHEN s > 1 THEN '...' ELSE '' END || substr(text, s, e - s) || CASE WHEN e <= length(text) THEN '...' ELSE '' END AS snippet FROM (SELECT doc_id, text, greatest(instr(lower(text), ' the ') - 50, 1) AS s, least(instr(lower(text), ' the ') + 5 + 50, length(text) + 1) AS e FROM documents WHERE contains(lower(text), ' the ') ORDER BY doc_id LIMIT 50)")
def search_chapters(t: Tables) -> DataFrame:
    return retrieval.search(t.documents, "doc_id", "text", " the ", 50)


@query("count_occurrences", "SELECT doc_id, ((length(text) - length(replace(text, 'the', ''))) // 3)::BIGINT AS n FROM documents WHERE contains(text, 'the')")
def count_occurrences(t: Tables) -> DataFrame:
    return t.documents.where(F.contains("text", F.lit("the"))).select("doc_id", tx.occurrences(F.col("text"), F.lit("the")).alias("n"))


@query(
    "ungrounded_names",
    r"""WITH c AS (SELECT string_agg(text, chr(0)) AS corpus FROM documents),
n AS (SELECT DISTINCT name, alias FROM (SELECT p_name AS name, p_name AS alias FROM part UNION ALL SELECT p_name, unnest(string_split(p_name, ' ')) FROM part UNION ALL SELECT text, unnest(regexp_split_to_array(text, '[^\p{L}\p{N} ]+')) FROM benchmark) WHERE length(alias) >= 2),
f AS (SELECT alias, contains(corpus, alias) AS found FROM (SELECT DISTINCT alias FROM n), c)
SELECT name FROM n JOIN f USING (alias) GROUP BY name HAVING NOT bool_or(found)""",
)
def ungrounded_names(t: Tables) -> DataFrame:
    """Parts, with their names' words as aliases, and passages, with their phrases, that no document grounds."""
    part = t.part.select(F.col("p_name").alias("name"), F.explode(F.array_union(F.array("p_name"), F.split("p_name", " "))).alias("alias"))
    bench = t.benchmark.select(F.col("text").alias("name"), F.explode(F.split("text", r"[^\p{L}\p{N} ]+")).alias("alias"))
    return search.ungrounded(part.union(bench), t.documents, "text")


_FORMS = r"SELECT DISTINCT source AS novel, lang || item_id AS name, unnest(regexp_split_to_array(b.text, '[^\p{L}\p{N} ]+')) AS alias FROM benchmark b, (SELECT DISTINCT source, lang FROM documents)"


@query(
    "ungrounded_by_novel",
    rf"""WITH c AS (SELECT source AS novel, string_agg(text, chr(0)) AS corpus FROM documents GROUP BY source), n AS ({_FORMS}),
f AS (SELECT novel, alias, contains(corpus, alias) AS found FROM (SELECT DISTINCT novel, alias FROM n WHERE length(alias) >= 2) JOIN c USING (novel))
SELECT novel, name FROM n JOIN f USING (novel, alias) GROUP BY ALL HAVING NOT bool_or(found)""",
)
def ungrounded_by_novel(t: Tables) -> DataFrame:
    """Passages as entities of each novel, their phrases as forms, looked for in the novel's own texts."""
    novels = F.broadcast(t.documents.select(F.col("source").alias("novel"), "lang").distinct())  # sources, a few
    forms = t.benchmark.select("item_id", F.explode(F.split("text", r"[^\p{L}\p{N} ]+")).alias("alias"))
    entities = forms.join(novels).select("novel", F.concat("lang", F.col("item_id").cast("string")).alias("name"), "alias").distinct()
    return search.ungrounded(entities, t.documents.withColumnRenamed("source", "novel"), "text", "novel")


_WORDS = "w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{3,}')) AS name FROM benchmark)"


def _words(t: Tables) -> DataFrame:
    return t.benchmark.select(F.explode(F.regexp_extract_all("text", F.lit("([a-z]{3,})"), F.lit(1))).alias("name")).distinct()


@query("longest_names", f"WITH {_WORDS}, p AS (SELECT string_agg(name, '|' ORDER BY length(name) DESC, name) AS pattern FROM w), h AS (SELECT doc_id, unnest(regexp_extract_all(text, pattern)) AS name FROM documents, p) SELECT doc_id, name, count(*) AS n FROM h GROUP BY ALL")
def longest_names(t: Tables) -> DataFrame:
    """How often each name stands in a document, none inside or across another."""
    return search.longest_counts(_words(t), t.documents, "doc_id", "text")


@query(
    "question_entities",
    f"""WITH {_WORDS}, a AS (SELECT name AS alias, left(name, 4) AS canonical FROM w WHERE length(name) > 4), h AS (SELECT DISTINCT conv_id, turn, coalesce(canonical, name) AS canonical, name FROM conversations c JOIN w ON contains(c.text, w.name) LEFT JOIN a ON alias = name),
f AS (SELECT conv_id, turn, canonical, max(length(name)) AS n, arg_min(name, (1000 - length(name))::VARCHAR || name) AS first FROM h GROUP BY ALL)
SELECT conv_id, turn, canonical AS name, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, first, canonical) AS place FROM f""",
)
def question_entities(t: Tables) -> DataFrame:
    """Entities of the messages by their canonical names, longest form first; long names stand for their beginnings."""
    words = _words(t)
    aliases = words.where(F.char_length("name") > 4).select(F.col("name").alias("alias"), F.substring("name", 1, 4).alias("canonical"))
    keyed = t.conversations.select(F.struct("conv_id", "turn").alias("k"), "text")
    return search.asked_entities(keyed, "k", "text", words, aliases).select("k.conv_id", "k.turn", "name", "place")


@query("names_in_questions", r"SELECT conv_id, turn, word AS name FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{4,}')) AS word FROM benchmark) b JOIN conversations c ON contains(c.text, b.word)")
def names_in_questions(t: Tables) -> DataFrame:
    names = t.benchmark.select(F.explode(F.regexp_extract_all("text", F.lit("([a-z]{4,})"), F.lit(1))).alias("name")).distinct()
    keyed = t.conversations.select(F.struct("conv_id", "turn").alias("k"), "text")
    return search.contained(names, keyed, "k", "text").select("k.conv_id", "k.turn", "name")


@query("nearest_vectors", "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) DESC, vec_id LIMIT 20")
def nearest_vectors(t: Tables) -> DataFrame:
    q = t.embeddings.where("vec_id = 0").select("embedding").first()[0]
    return retrieval.nearest(t.embeddings, "vec_id", "embedding", q, 20).select("vec_id")


@query("nearest_of_label", "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id FROM embeddings, q WHERE label = 3 ORDER BY list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) DESC, vec_id LIMIT 10")
def nearest_of_label(t: Tables) -> DataFrame:
    q = t.embeddings.where("vec_id = 0").select("embedding").first()[0]
    return retrieval.nearest(t.embeddings.where("label = 3"), "vec_id", "embedding", q, 10).select("vec_id")


@query("context_budget", "SELECT conv_id, turn, used FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS used FROM conversations) WHERE used <= 1500")
def context_budget(t: Tables) -> DataFrame:
    return retrieval.within_budget(t.conversations, ["conv_id"], "turn", "text", 1500).select("conv_id", "turn", "used")


@query("history_text", "SELECT conv_id, string_agg(role || ': ' || substr(text, 1, 200), chr(10) ORDER BY turn) AS history FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 6 GROUP BY conv_id")
def history_text(t: Tables) -> DataFrame:
    k = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    rows = t.conversations.withColumn("k", k).where("k <= 6").select("conv_id", "turn", F.concat_ws(": ", "role", F.substring("text", 1, 200)).alias("line"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy("conv_id").agg(joined.alias("history"))


@query(
    "scene_tones",
    """WITH ev AS (SELECT l_orderkey AS k, l_linenumber::BIGINT AS event, l_suppkey % 10 AS member FROM lineitem WHERE l_linestatus = 'O'), sc AS (SELECT l_orderkey AS k, l_linenumber::BIGINT AS scene, l_returnflag AS tone, l_suppkey % 10 AS member FROM lineitem WHERE l_linestatus = 'F'),
n AS (SELECT k, event, scene, tone, count(DISTINCT member) AS shared FROM ev JOIN sc USING (k, member) GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY k, event ORDER BY shared DESC, scene, tone DESC) AS j FROM n)
SELECT k, event, shared FROM b WHERE j = 1""",
)
def scene_tones(t: Tables) -> DataFrame:
    ev = t.lineitem.where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("event"), (F.col("l_suppkey") % 10).alias("member"))
    sc = t.lineitem.where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("scene"), F.col("l_returnflag").alias("tone"), (F.col("l_suppkey") % 10).alias("member"))
    return retrieval.best_overlap(ev, sc, "k", "event", "scene", "tone").select("k", "event", "shared")


@query("numbered_paragraphs", "SELECT item_id, string_agg('[' || k || '] ' || line, chr(10) ORDER BY k) AS text FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM benchmark) GROUP BY item_id")
def numbered_paragraphs(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", tx.numbered(F.col("text")).alias("text"))


@query("restored_paragraphs", r"SELECT doc_id, sha256(CASE WHEN length(text) >= 1000 AND (length(text) - length(replace(text, chr(10), ''))) * 2000 < length(text) THEN regexp_replace(text, '([.!?。！？])[ 　]+', '\1' || chr(10), 'g') ELSE text END) AS hash FROM documents")
def restored_paragraphs(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2(tx.paragraphs_restored(F.col("text")).cast("binary"), 256).alias("hash"))


@query("text_shape", "SELECT doc_id, length(text) AS chars, len(string_split(text, chr(10))) AS n_lines, len(list_filter(string_split(text, chr(10)), lambda x: length(x) BETWEEN 1 AND 40)) AS headings FROM documents")
def text_shape(t: Tables) -> DataFrame:
    parts = F.split("text", "\n")
    short = F.filter(parts, lambda x: F.char_length(x).between(1, 40))
    return t.documents.select("doc_id", F.char_length("text").cast("long").alias("chars"), F.size(parts).cast("long").alias("n_lines"), F.size(short).cast("long").alias("headings"))


@query(
    "split_diagnosis",
    """SELECT source, CASE WHEN n = 1 AND m > 30000 THEN 'SINGLE_HUGE_CHAPTER' WHEN n < 5 AND s > 100000 THEN 'HEADING_TOO_SPARSE' WHEN n > 10 AND s // n < 500 THEN 'HEADING_TOO_DENSE' ELSE 'OK' END AS diagnosis, n, s AS total
FROM (SELECT source, count(*) AS n, max(length(text)) AS m, sum(length(text))::BIGINT AS s FROM documents GROUP BY source)""",
)
def split_diagnosis(t: Tables) -> DataFrame:
    g = t.documents.groupBy("source").agg(F.count("*").alias("n"), F.max(F.char_length("text")).alias("m"), F.sum(F.char_length("text")).alias("s"))
    n, m, s = F.col("n"), F.col("m"), F.col("s")
    kind = F.when((n == 1) & (m > 30000), "SINGLE_HUGE_CHAPTER").when((n < 5) & (s > 100000), "HEADING_TOO_SPARSE").when((n > 10) & (F.floor(s / n) < 500), "HEADING_TOO_DENSE").otherwise("OK")
    return g.select("source", kind.alias("diagnosis"), "n", s.alias("total"))


_NUM = r"[零〇一二两三四五六七八九十百千万\d]+"
_HEADED = "h AS (SELECT c_nationkey AS book, c_custkey AS k, c_mktsegment || ' ' || c_custkey || ': ' || c_name AS line FROM customer), m AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY book ORDER BY k) <= 3)"


@query(
    "induced_patterns",
    rf"""WITH {_HEADED}, p AS (SELECT book, '^' || CASE WHEN count(DISTINCT split_part(line, ' ', 1)) = 1 THEN min(split_part(line, ' ', 1)) ELSE '[a-zA-Z]+' END || '\s+{_NUM}:\s+Customer\#{_NUM}' AS pattern FROM m GROUP BY book HAVING count(*) >= 2)
SELECT book, pattern, count(*) AS hits FROM p JOIN h USING (book) WHERE regexp_matches(line, pattern) GROUP BY ALL HAVING count(*) >= 2""",
)
def induced_patterns(t: Tables) -> DataFrame:
    """Forms of the headings of a nation's customers, from the first three of each."""
    line = F.concat("c_mktsegment", F.lit(" "), F.col("c_custkey").cast("string"), F.lit(": "), F.col("c_name"))
    lines = t.customer.select(F.col("c_nationkey").alias("book"), F.col("c_custkey").alias("k"), line.alias("line"))
    first = F.row_number().over(W.partitionBy("book").orderBy("k"))
    return induce.induced(lines.withColumn("n", first).where("n <= 3"), lines, "book")
