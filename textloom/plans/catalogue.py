"""The engine's queries, each over whole tables, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.embedders import CharTokenEmbedder, TopicEmbedder
from ..kernels.chunkers import SENTENCE_ENDS
from ..operators import chunking as ops
from ..operators import documents, series
from .oracles import WHITE, bytes_consecutive_sql, bytes_patterns_sql, code_sql, late_sql, one_byte_each, recursive_chunks_sql, sentence_overlap_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TOPICS = ["the", "tion", "er", "de"]


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.ensure_parallelism(table(spark, sf_dir, "documents").select("doc_id", "text"))


def windows_sql(size: int, stride: int) -> str:
    return f"""
SELECT doc_id, CAST(k AS BIGINT) AS chunk_index, CAST(strlen(substr(text, 1, CAST(k * {stride} AS INTEGER))) AS BIGINT) AS start_index,
       CAST(strlen(substr(text, 1, CAST(least(k * {stride} + {size}, n) AS INTEGER))) AS BIGINT) AS end_index,
       CAST(least({size}, n - k * {stride}) AS BIGINT) AS token_count, substr(text, CAST(k * {stride} + 1 AS INTEGER), {size}) AS text
FROM (SELECT doc_id, text, length(text) AS n FROM documents WHERE NOT regexp_full_match(text, {WHITE})),
     unnest(range(0, CASE WHEN n <= {size} THEN 1 ELSE 1 + CAST(ceil((n - {size}) / {float(stride)}) AS BIGINT) END)) AS r(k)"""


@query(windows_sql(64, 56))
def token_overlap(spark, sf_dir):
    return ops.chunk_token(texts(spark, sf_dir), chunk_size=64, chunk_overlap=8)


@query(windows_sql(256, 256))
def token_char(spark, sf_dir):
    return ops.chunk_token(texts(spark, sf_dir), chunk_size=256)


@query(windows_sql(128, 96))
def token_fraction(spark, sf_dir):
    return ops.chunk_token(texts(spark, sf_dir), chunk_size=128, chunk_overlap=0.25)


@query("""
WITH w AS (SELECT conv_id, turn, text, regexp_extract_all(text, '[^ ]+ *| +') AS t FROM conversations)
SELECT conv_id, turn, CAST(k AS BIGINT) AS chunk_index, CAST(strlen(array_to_string(t[1:k * 10], '')) AS BIGINT) AS start_index,
       CAST(strlen(array_to_string(t[1:k * 10 + 10], '')) AS BIGINT) AS end_index, CAST(least(10, len(t) - k * 10) AS BIGINT) AS token_count,
       array_to_string(t[k * 10 + 1:k * 10 + 10], '') AS text
FROM w, unnest(range(0, (len(t) + 9) // 10)) AS r(k) WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''""")
def token_word(spark, sf_dir):
    return ops.chunk_token(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), chunk_size=10, tokenizer="word")


@query("""
SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(strlen(text) AS BIGINT) AS octets,
       CAST(len(regexp_extract_all(text, '[^ ]+ *| +')) AS BIGINT) AS words,
       CAST(CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS BIGINT) AS n_rows FROM documents""")
def count_tokens(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", C.count_characters("text").alias("chars"), C.count_bytes("text").alias("octets"), C.count_words("text").alias("words"), C.count_rows("text").alias("n_rows"))


def segments_sql(parts: str) -> str:
    return f"""
SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, s[i] AS segment
FROM (SELECT doc_id, {parts} AS s FROM documents), unnest(range(1, len(s) + 1)) AS r(i)"""


def _exploded(df: DataFrame, parts) -> DataFrame:
    return df.select("doc_id", F.posexplode_outer(parts).alias("pos", "segment")).where("pos is not null").select("doc_id", F.col("pos").cast("long").alias("pos"), "segment")


@query(segments_sql(r"regexp_extract_all(text, '(?s)([^\n.?]*[\n.?]|[^\n.?]+$)', 1)"))
def split_prev(spark, sf_dir):
    return _exploded(texts(spark, sf_dir), C.segments("text", ("\n", ".", "?"), "prev"))


@query(segments_sql(r"list_filter(regexp_extract_all(text, '(?s)([\n.?][^\n.?]*|^[^\n.?]+)', 1), lambda x: x <> '')"))
def split_next(spark, sf_dir):
    return _exploded(texts(spark, sf_dir), C.segments("text", ("\n", ".", "?"), "next"))


@query(segments_sql(r"list_filter(string_split_regex(text, '[\n.?]'), lambda x: x <> '')"))
def split_none(spark, sf_dir):
    return _exploded(texts(spark, sf_dir), C.segments("text", ("\n", ".", "?"), "none"))


PATTERNS = r"list_filter(regexp_extract_all(text, '(?s)(.*?(?:\. |! |\? |\n)|.+$)', 1), lambda x: x <> '')"


@query(segments_sql(PATTERNS))
def split_patterns(spark, sf_dir):
    return ops.split_text(texts(spark, sf_dir), SENTENCE_ENDS).select("doc_id", "pos", "segment")


MERGED = f"""
WITH RECURSIVE seg AS (SELECT doc_id, {PATTERNS} AS s FROM documents),
fold AS (
  SELECT doc_id, s, 1 AS i, CAST([] AS VARCHAR[]) AS done, s[1] AS held FROM seg WHERE len(s) > 0
  UNION ALL
  SELECT doc_id, s, i + 1, CASE WHEN strlen(held) < 12 OR strlen(s[i + 1]) < 12 THEN done ELSE list_append(done, held) END,
         CASE WHEN strlen(held) < 12 OR strlen(s[i + 1]) < 12 THEN held || s[i + 1] ELSE s[i + 1] END
  FROM fold WHERE i < len(s)),
merged AS (SELECT doc_id, list_append(done, held) AS m FROM fold WHERE i = len(s))"""


@query(MERGED + " SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, m[i] AS segment FROM merged, unnest(range(1, len(m) + 1)) AS r(i)")
def split_min(spark, sf_dir):
    return ops.split_text(texts(spark, sf_dir), SENTENCE_ENDS, min_chars=12).select("doc_id", "pos", "segment")


@query(segments_sql(r"regexp_extract_all(text, '([^\n]*\n|[^\n]+$)', 1)"))
def line_ranges(spark, sf_dir):
    return ops.split_lines(texts(spark, sf_dir)).select("doc_id", "pos", "segment")


def packed_sql(size: int) -> str:
    return f"""{MERGED},
pack AS (
  SELECT doc_id, m, 1 AS i, 0 AS g, length(m[1]) AS n FROM merged
  UNION ALL
  SELECT doc_id, m, i + 1, CASE WHEN n + length(m[i + 1]) > {size} THEN g + 1 ELSE g END,
         CASE WHEN n + length(m[i + 1]) > {size} THEN length(m[i + 1]) ELSE n + length(m[i + 1]) END
  FROM pack WHERE i < len(m)),
chunks AS (SELECT doc_id, g, string_agg(m[i], '' ORDER BY i) AS text FROM pack GROUP BY doc_id, g)
SELECT doc_id, CAST(g AS BIGINT) AS chunk_index, CAST(coalesce(sum(strlen(text)) OVER (PARTITION BY doc_id ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_index,
       CAST(sum(strlen(text)) OVER (PARTITION BY doc_id ORDER BY g) AS BIGINT) AS end_index, CAST(length(text) AS BIGINT) AS token_count, text FROM chunks"""


@query(packed_sql(512).replace("FROM documents)", "FROM documents WHERE NOT regexp_full_match(text, " + WHITE + "))", 1))
def sentence_512(spark, sf_dir):
    return ops.chunk_sentence(texts(spark, sf_dir), chunk_size=512)


@query(sentence_overlap_sql(512, 128, 2))
def sentence_overlap(spark, sf_dir):
    return ops.chunk_sentence(texts(spark, sf_dir), chunk_size=512, chunk_overlap=128, min_sentences_per_chunk=2)


@query(recursive_chunks_sql(512))
def recursive_512(spark, sf_dir):
    return ops.chunk_recursive(texts(spark, sf_dir), chunk_size=512)


FOLD = """
WITH lines AS (SELECT l_orderkey AS series, list(CAST(l_quantity AS BIGINT) ORDER BY l_linenumber, l_quantity) AS c FROM lineitem GROUP BY 1),
folded AS (SELECT series, c, list_reduce(list_transform(c, lambda x: {'held': x, 'at': 1, 'ends': CAST([] AS INTEGER[])}),
  lambda a, x: {'held': CASE WHEN a.held + x.held > 60 THEN x.held ELSE a.held + x.held END, 'at': a.at + 1,
                'ends': CASE WHEN a.held + x.held > 60 THEN list_append(a.ends, a.at) ELSE a.ends END}) AS f FROM lines),
ended AS (SELECT series, c, list_append(f.ends, f.at) AS e FROM folded)"""


def _quantities(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("series"), F.col("l_linenumber").alias("pos"), F.col("l_quantity").cast("long").alias("tokens"))
    return rows.withColumn("split", F.concat(F.lit("<"), F.col("tokens").cast("string"), F.lit(">")))


@query(FOLD + " SELECT series, CAST(i - 1 AS BIGINT) AS pos, CAST(e[i] AS BIGINT) AS end_index FROM ended, unnest(range(1, len(e) + 1)) AS r(i)")
def merge_indices(spark, sf_dir):
    rows = _quantities(spark, sf_dir).groupBy("series").agg(F.array_sort(F.collect_list(F.struct("pos", "tokens"))).alias("a"))
    ends = C.merge_indices(F.transform("a", lambda x: x["tokens"]), 60)
    return rows.select("series", F.posexplode_outer(ends).alias("pos", "end")).select("series", F.col("pos").cast("long").alias("pos"), F.col("end").cast("long").alias("end_index"))


@query(FOLD + """ SELECT series, CAST(i - 1 AS BIGINT) AS "group", CAST(list_sum(c[(CASE WHEN i = 1 THEN 0 ELSE e[i - 1] END) + 1:e[i]]) AS BIGINT) AS token_count,
  array_to_string(list_transform(c[(CASE WHEN i = 1 THEN 0 ELSE e[i - 1] END) + 1:e[i]], lambda x: '<' || x || '>'), '') AS merged
FROM ended, unnest(range(1, len(e) + 1)) AS r(i)""")
def merge_splits(spark, sf_dir):
    return series.merge_groups(_quantities(spark, sf_dir), 60)


def bytes_sql(size: int) -> str:
    return f"""
WITH RECURSIVE ascii AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) = strlen(text)),
cuts AS (
  SELECT doc_id, text, n, 0 AS i, 0 AS s, 0 AS e FROM ascii WHERE n > 0
  UNION ALL
  SELECT doc_id, text, n, i + 1, e, CASE WHEN n - e <= {size} THEN n
    ELSE e + CASE WHEN length(regexp_extract(substr(text, e + 1, {size}), '(?s)^.+[\\n.?]')) > 1 THEN length(regexp_extract(substr(text, e + 1, {size}), '(?s)^.+[\\n.?]')) ELSE {size} END END
  FROM cuts WHERE e < n)
SELECT doc_id, CAST(i - 1 AS BIGINT) AS chunk_index, CAST(s AS BIGINT) AS start_index, CAST(e AS BIGINT) AS end_index FROM cuts WHERE i > 0"""


@query(bytes_sql(200).replace("SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) = strlen(text)", f"SELECT doc_id, {one_byte_each("text")} AS text, strlen(documents.text) AS n FROM documents"))
def bytes_default(spark, sf_dir):
    return ops.chunk_offsets(texts(spark, sf_dir), size=200)


@query(bytes_patterns_sql(200))
def bytes_patterns(spark, sf_dir):
    return ops.chunk_offsets(texts(spark, sf_dir), size=200, delimiters="\n", patterns=[". ", "tion ", "é", "ß "], prefix=True, forward_fallback=True)


@query(bytes_consecutive_sql(100))
def bytes_consecutive(spark, sf_dir):
    return ops.chunk_offsets(texts(spark, sf_dir), size=100, delimiters=" ", prefix=True, consecutive=True, forward_fallback=True)


ROWS = "SELECT c_nationkey AS k, c_custkey AS i, '| ' || c_custkey || ' | ' || c_name || ' |' || chr(10) AS r FROM customer"


@query(f"""
WITH rows AS ({ROWS}), numbered AS (SELECT k, r, row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS p, count(*) OVER (PARTITION BY k) AS n FROM rows)
SELECT CAST(k AS BIGINT) AS k, CAST(p // 5 AS BIGINT) AS chunk_index, CAST(count(*) AS BIGINT) AS token_count,
       '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg(r, '' ORDER BY p) AS text
FROM numbered GROUP BY k, p // 5""")
def table_md_rows(spark, sf_dir):
    made = _customers(spark, sf_dir, "| key | name |\n" + "| --- " * 2 + "|\n", F.concat(F.lit("| "), F.col("c_custkey").cast("string"), F.lit(" | "), F.col("c_name"), F.lit(" |\n")), "")
    return ops.chunk_table(made, chunk_size=5).select("k", "chunk_index", "token_count", "text")


def _customers(spark, sf_dir, head, row, foot) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("k"), F.struct("c_custkey", row.alias("r")).alias("x"))
    body = rows.groupBy("k").agg(F.array_sort(F.collect_list("x")).alias("a"))
    return body.select("k", F.concat(F.lit(head), F.array_join(F.transform("a", lambda x: x["r"]), ""), F.lit(foot)).alias("text"))


@query("""
WITH numbered AS (SELECT c_nationkey AS k, '<tr><td>' || c_name || '</td></tr>' AS r, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS p,
                         count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
SELECT CAST(k AS BIGINT) AS k, CAST(p // 4 AS BIGINT) AS chunk_index, CAST(count(*) AS BIGINT) AS token_count,
       '<table><tbody class="a>b">' || string_agg(r, '' ORDER BY p) || '</tbody></table>' AS text
FROM numbered GROUP BY k, p // 4""")
def table_html(spark, sf_dir):
    made = _customers(spark, sf_dir, '<table><tbody class="a>b">', F.concat(F.lit("<tr><td>"), F.col("c_name"), F.lit("</td></tr>")), "</tbody></table>")
    return ops.chunk_table(made, chunk_size=4).select("k", "chunk_index", "token_count", "text")


@query("""
WITH src AS (SELECT c_nationkey AS k, c_custkey AS i, 'void f' || c_custkey || '() {' || chr(10) || '  g();' || chr(10) || '}' || chr(10) AS r FROM customer),
n AS (SELECT k, r, row_number() OVER (PARTITION BY k ORDER BY i) AS p FROM src)
SELECT CAST(k AS BIGINT) AS k, CAST(p - 1 AS BIGINT) AS chunk_index, CAST(length(r) AS BIGINT) AS token_count, r AS text FROM n""")
def code_brace(spark, sf_dir):
    made = _customers(spark, sf_dir, "", F.concat(F.lit("void f"), F.col("c_custkey").cast("string"), F.lit("() {\n  g();\n}\n")), "")
    return ops.chunk_code(made, chunk_size=30, language="c").select("k", "chunk_index", "token_count", "text")


@query(code_sql(256))
def code_auto(spark, sf_dir):
    return ops.chunk_code(texts(spark, sf_dir), chunk_size=256)


def _signal(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("series"), F.col("event_id").alias("pos"), "value")


REFLECT = """
WITH s AS (SELECT user_id AS series, list(value ORDER BY event_id) AS v, list(event_id ORDER BY event_id) AS p FROM events GROUP BY 1),
e AS (SELECT series, v, p, i, len(v) AS n FROM s, unnest(range(0, len(v))) AS r(i)),
x AS (SELECT series, p[i + 1] AS pos, v[i + 1] AS value, i, list_transform(range(-2, 3), lambda d: v[1 + greatest(0, least(n - 1,
  CASE WHEN abs(i + d) >= n THEN 2 * n - abs(i + d) - 2 ELSE abs(i + d) END))]) AS w FROM e)"""


def smooth_sql(weights: list[str]) -> str:
    return " + ".join(f"({w}) * w[{j}]" for j, w in enumerate(weights, 1))


D1, D2 = smooth_sql(["-2/10.0", "-1/10.0", "0", "1/10.0", "2/10.0"]), smooth_sql(["2/7.0", "-1/7.0", "-2/7.0", "-1/7.0", "2/7.0"])


@query(REFLECT + " SELECT series, pos, value, round(" + smooth_sql(["-3/35.0", "12/35.0", "17/35.0", "12/35.0", "-3/35.0"]) + ", 6) + 0 AS filtered FROM x")
def savgol_smooth(spark, sf_dir):
    out = series.savgol_filter(_signal(spark, sf_dir))
    return out.withColumn("filtered", F.round("filtered", 6) + 0.0)


@query(REFLECT + f" SELECT series, pos, round({D1}, 6) + 0 AS filtered FROM x")
def savgol_d1(spark, sf_dir):
    out = series.savgol_filter(_signal(spark, sf_dir), window=5, poly=2, deriv=1)
    return out.select("series", "pos", (F.round("filtered", 6) + 0.0).alias("filtered"))


@query(REFLECT + f" SELECT series, pos, value, CAST(i AS BIGINT) AS idx FROM x WHERE abs({D1}) < 2 AND {D2} > 0")
def local_minima(spark, sf_dir):
    return series.local_minima(_signal(spark, sf_dir), window=5, poly=2, tolerance=2.0)


@query("""
WITH q AS (SELECT user_id AS series, event_id AS idx, value, quantile_cont(value, 0.4) OVER (PARTITION BY user_id) AS lim FROM events)
SELECT series, idx, value FROM q WHERE value <= lim""")
def filter_split(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("series"), F.col("event_id").alias("idx"), "value")
    return series.filter_split_indices(rows, threshold=0.4, min_distance=1)


@query("""
WITH q AS (SELECT user_id AS series, event_id AS idx, value, quantile_cont(value, 0.4) OVER (PARTITION BY user_id) AS lim FROM events),
k AS (SELECT series, list({'i': idx, 'v': value} ORDER BY idx) AS a FROM q WHERE value <= lim GROUP BY series),
f AS (SELECT series, list_reduce(list_transform(a, lambda x: [x]), lambda got, x: CASE WHEN x[1].i - got[len(got)].i >= 100 THEN list_concat(got, x) ELSE got END) AS g FROM k)
SELECT series, x.i AS idx, x.v AS value FROM f, unnest(g) AS t(x)""")
def filter_split_thinned(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("series"), F.col("event_id").alias("idx"), "value")
    return series.filter_split_indices(rows, threshold=0.4, min_distance=100)


@query("""
WITH p AS (SELECT label, vec_id, embedding AS a, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings),
c AS (SELECT label, vec_id, list_cosine_similarity(CAST(a AS DOUBLE[]), CAST(b AS DOUBLE[])) AS c FROM p WHERE b IS NOT NULL)
SELECT label, vec_id, round(avg(c) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS similarity FROM c""")
def cross_similarity(spark, sf_dir):
    out = series.cross_similarity(table(spark, sf_dir, "embeddings"), keys=("label",), order="vec_id")
    return out.select("label", "vec_id", F.round("similarity", 6).alias("similarity"))


@query("""
WITH d AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, unnest(range(1, len(embedding) + 1)) AS r(i) GROUP BY label, i),
c AS (SELECT label, list(m ORDER BY i) AS m FROM d GROUP BY label)
SELECT vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), m), 6) AS cosine FROM embeddings JOIN c USING (label)""")
def cosine_to_mean(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    means = series.mean_vectors(e, keys=("label",)).withColumnRenamed("embedding", "mean")
    return e.join(means, "label").select("vec_id", "label", F.round(C.cosine("embedding", "mean"), 6).alias("cosine"))


@query("SELECT doc_id, " + ", ".join(f"CAST((length(lower(text)) - length(replace(lower(text), '{k}', ''))) // {len(k)} AS DOUBLE) AS t{i}" for i, k in enumerate(TOPICS)) + " FROM documents")
def topic_embed(spark, sf_dir):
    v = texts(spark, sf_dir).select("doc_id", C.keyword_vector("text", TOPICS).alias("v"))
    return v.select("doc_id", *[F.col("v")[i].alias(f"t{i}") for i in range(len(TOPICS))])


@query()
def semantic_topic(spark, sf_dir):
    return ops.chunk_semantic(texts(spark, sf_dir), TopicEmbedder(TOPICS), threshold=0.5)


@query()
def sdpm_topic(spark, sf_dir):
    return ops.chunk_sdpm(texts(spark, sf_dir), TopicEmbedder(TOPICS), threshold=0.5)


@query(late_sql(512))
def late_pool(spark, sf_dir):
    out = ops.chunk_late(texts(spark, sf_dir), CharTokenEmbedder(4), chunk_size=512)
    return out.select("doc_id", "chunk_index", "token_count", *[F.round(F.col("embedding")[k].cast("double") * F.col("token_count")).cast("long").alias(f"sum{k}") for k in (0, 1)])


@query("""
SELECT n_nationkey AS k, CAST(pos AS BIGINT) AS pos, kind, path AS heading FROM nation,
  (VALUES (0, 'heading', 'a'), (1, 'prose', 'a'), (2, 'heading', 'a/b'), (3, 'list', 'a/b'), (4, 'table', 'a/b'), (5, 'code', 'a/b')) AS v(pos, kind, path)""")
def md_segments(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    text = F.concat(F.lit("# a #\n\n"), F.col("n_name"), F.lit(" is a nation.\n\n## b\n\n- one\n\n- two\n\n| x |\n|---|\n| 1 |\n\n```py\n# no\n```\n"))
    return documents.segment_documents(n.select(F.col("n_nationkey").alias("k"), text.alias("markdown"))).select("k", "pos", "kind", F.array_join("heading_path", "/").alias("heading"))


@query()
def md_chunks(spark, sf_dir):
    key = F.col("doc_id").cast("string")
    tail = F.concat(F.lit("\n\n## Data\n\n| key | twice |\n|---|---|\n| "), key, F.lit(" | "), (F.col("doc_id") * 2).cast("string"), F.lit(" |\n\n```py\nkey = "), key, F.lit("\n```\n"))
    made = texts(spark, sf_dir).select("doc_id", F.concat(F.lit("# Doc "), key, F.lit("\n\n"), F.col("text"), tail).alias("markdown"))
    return documents.chunk_markdown(made)


def _converted(rows: DataFrame, content, format: str) -> DataFrame:
    return documents.convert_documents(rows.select("k", F.encode(content, "UTF-8").alias("content")), format=format).select("k", "markdown")


@query("""
SELECT CAST(c_nationkey AS BIGINT) AS k, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || c_custkey || ' | ' || c_name || ', Esq. |' || chr(10), '' ORDER BY c_custkey) AS markdown
FROM customer GROUP BY c_nationkey""")
def csv_to_md(spark, sf_dir):
    made = _customers(spark, sf_dir, "key,name\n", F.concat(F.col("c_custkey").cast("string"), F.lit(',"'), F.col("c_name"), F.lit(', Esq."\n')), "")
    return _converted(made, F.col("text"), "csv")


@query("SELECT CAST(c_custkey AS BIGINT) AS k, c_name || chr(10) || chr(10) || 'Größe {' || c_nationkey || '}' || chr(10) AS markdown FROM customer")
def rtf_to_md(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"), "c_name", F.col("c_nationkey").cast("string").alias("n"))
    head = "{\\rtf1\\ansi{\\fonttbl{\\f0 Arial;}}\\f0 "
    return _converted(rows, F.concat(F.lit(head), F.col("c_name"), F.lit("\\par Gr\\'f6\\u223 ?e \\{"), F.col("n"), F.lit("\\}}")), "rtf")


@query("SELECT CAST(c_custkey AS BIGINT) AS k, '# ' || c_name || chr(10) || chr(10) || 'One of the customers' || chr(10) || 'of nation (' || c_nationkey || ')' || chr(10) AS markdown FROM customer")
def pdf_to_md(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"), "c_name", F.col("c_nationkey").cast("string").alias("n"))
    head, mid = "%PDF-1.4\nstream\nBT /F1 20 Tf (", ") Tj ET BT /F1 10 Tf 0 -30 Td [(One of the) -300 (customers)] TJ T* (of nation \\("
    return _converted(rows, F.concat(F.lit(head), F.col("c_name"), F.lit(mid), F.col("n"), F.lit("\\)) Tj ET\nendstream\n")), "pdf")
