"""DuckDB SQL of chunkers that need recursion: greedy packing with overlap, recursive levels, byte windows."""

from __future__ import annotations

#: White space alone, as the chunkers see it.
WHITE = "'[\\t-\\r \\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]*'"


def split_sql(name: str, source: str, ends: str, least: int) -> str:
    """CTEs up to ``name`` (doc_id, start, m, t, b): spans of ``source`` (doc_id, start, text), short ones merged, and sums of characters and bytes."""
    return f"""
{name}_s AS (SELECT doc_id, start, list_filter(regexp_extract_all(text, '(?s)(.*?(?:{ends})|.+$)', 1), lambda x: x <> '') AS s FROM {source} WHERE text <> ''),
{name}_f AS (
  SELECT doc_id, start, s, 1 AS i, CAST([] AS VARCHAR[]) AS done, s[1] AS held FROM {name}_s
  UNION ALL
  SELECT doc_id, start, s, i + 1, CASE WHEN strlen(held) < {least} OR strlen(s[i + 1]) < {least} THEN done ELSE list_append(done, held) END,
         CASE WHEN strlen(held) < {least} OR strlen(s[i + 1]) < {least} THEN held || s[i + 1] ELSE s[i + 1] END
  FROM {name}_f WHERE i < len(s)),
{name}_m AS (SELECT doc_id, start, list_append(done, held) AS m FROM {name}_f WHERE i = len(s)),
{name}_c AS (
  SELECT doc_id, start, i, CAST(sum(length(m[i])) OVER w AS BIGINT) AS t, CAST(sum(strlen(m[i])) OVER w AS BIGINT) AS b
  FROM {name}_m, unnest(range(1, len(m) + 1)) AS r(i) WINDOW w AS (PARTITION BY doc_id, start ORDER BY i)),
{name}_l AS (SELECT doc_id, start, list_prepend(0, list(t ORDER BY i)) AS t, list_prepend(0, list(b ORDER BY i)) AS b FROM {name}_c GROUP BY doc_id, start),
{name} AS (SELECT doc_id, start, m, t, b FROM {name}_m JOIN {name}_l USING (doc_id, start))"""


def pack_sql(name: str, source: str, size: int, overlap: int = 0, least: int = 1) -> str:
    """CTEs up to ``name`` (doc_id, start, n, text, k): groups of ``source``'s spans of ``size`` characters at most, ``least`` spans at least."""
    fits = f"least(len(t) - 1, greatest(a + {least}, a + len(list_filter(t[a + 2:], lambda x: x <= t[a + 1] + {size}))))"
    back = f"len(list_filter(range(1, z - a), lambda q: t[z + 1] - t[z - q + 1] + q <= {overlap}))" if overlap else "0"
    return f"""
{name}_p AS (
  SELECT doc_id, start, t, 0 AS k, CAST(0 AS BIGINT) AS a, CAST({fits.replace("a + ", "0 + ")} AS BIGINT) AS z FROM {source}
  UNION ALL
  SELECT doc_id, start, t, k + 1, a, CAST({fits} AS BIGINT) AS z
  FROM (SELECT doc_id, start, t, k, CAST(z - {back} AS BIGINT) AS a FROM {name}_p WHERE z < len(t) - 1)),
{name} AS (SELECT p.doc_id, p.start + b[a + 1] AS start, p.t[z + 1] - p.t[a + 1] AS n, array_to_string(m[a + 1:z], '') AS text, k
           FROM {name}_p AS p JOIN {source} AS s ON p.doc_id = s.doc_id AND p.start = s.start)"""


SENTENCES = r"\. |! |\? |\n"


def sentence_overlap_sql(size: int, overlap: int, least: int) -> str:
    return f"""
WITH RECURSIVE docs AS (SELECT doc_id, CAST(0 AS BIGINT) AS start, text FROM documents WHERE NOT regexp_full_match(text, {WHITE})),
{split_sql("one", "docs", SENTENCES, 12)},
{pack_sql("two", "one", size, overlap, least)}
SELECT doc_id, CAST(k AS BIGINT) AS chunk_index, start AS start_index, CAST(start + strlen(text) AS BIGINT) AS end_index, CAST(length(text) AS BIGINT) AS token_count, text FROM two"""


LEVELS = ["\\n\\n|\\r\\n|\\n|\\r", r"\. |! |\? ", r"\{|\}|""\"" + r"|\[|\]|<|>|\(|\)|:|;|,|—|\||~|-|\.\.\.|`|''", " "]


def recursive_sql(size: int) -> str:
    """CTEs up to ``chunks`` (doc_id, start, text, n, i): the default rules, level by level; what is too long goes to the next."""
    parts, source = ["WITH RECURSIVE l0 AS (SELECT doc_id, CAST(0 AS BIGINT) AS start, text FROM documents)"], "l0"
    for d, ends in enumerate(LEVELS):
        parts += [split_sql(f"x{d}", source, ends, 24), pack_sql(f"y{d}", f"x{d}", size), f"\nl{d + 1} AS (SELECT doc_id, start, text FROM y{d} WHERE n > {size})"]
        source = f"l{d + 1}"
    done = " UNION ALL ".join(f"SELECT doc_id, start, text, n FROM y{d} WHERE n <= {size}" for d in range(len(LEVELS)))
    cut = f"""
SELECT doc_id, start + strlen(substr(text, 1, CAST(k * {size} AS INTEGER))) AS start, substr(text, CAST(k * {size} + 1 AS INTEGER), {size}) AS text, least({size}, length(text) - k * {size}) AS n
FROM {source}, unnest(range(0, (length(text) + {size - 1}) // {size})) AS r(k)"""
    parts.append(f"\nchunks AS (SELECT doc_id, start, text, n, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS i FROM ({done} UNION ALL {cut}))")
    return ",".join(parts)


def recursive_chunks_sql(size: int) -> str:
    return recursive_sql(size) + """
SELECT doc_id, CAST(i AS BIGINT) AS chunk_index, CAST(start AS BIGINT) AS start_index, CAST(start + strlen(text) AS BIGINT) AS end_index, CAST(n AS BIGINT) AS token_count, text FROM chunks"""


def late_sql(size: int) -> str:
    """Sums (means by number of tokens) of a chunk's code points modulo 97 and of their places in the document modulo 13."""
    return recursive_sql(size) + f"""
, placed AS (SELECT doc_id, i, text, n, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY i) - n AS BIGINT) AS before FROM chunks
         WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE regexp_full_match(text, {WHITE}))),
chars AS (SELECT doc_id, i, n, unicode(substr(text, CAST(j AS INTEGER), 1)) % 97 AS c, (before + j - 1) % 13 AS p FROM placed, unnest(range(1, n + 1)) AS r(j))
SELECT doc_id, CAST(i AS BIGINT) AS chunk_index, CAST(n AS BIGINT) AS token_count, CAST(sum(c) AS BIGINT) AS sum0, CAST(sum(p) AS BIGINT) AS sum1 FROM chars GROUP BY doc_id, i, n"""


def one_byte_each(text: str, kept: dict[str, str] | None = None) -> str:
    """Each character as so many ASCII ones as it has bytes in UTF-8, so that SQL's places are bytes; ``kept`` have signs of their own."""
    for c, signs in (kept or {}).items():
        text = f"replace({text}, '{c}', {signs})"
    for low, high, n in (("80", "7FF", 2), ("800", "FFFF", 3), ("10000", "10FFFF", 4)):
        text = f"regexp_replace({text}, '[\\x{{{low}}}-\\x{{{high}}}]', '{'x' * n}', 'g')"
    return text


def _cuts(bytes_of: str, size: int, place: str) -> str:
    """Cuts from each one to the next; ``place`` is the next one's place for window w of text b from e on, or NULL where there is none."""
    return f"""
WITH RECURSIVE b AS (SELECT doc_id, {bytes_of} AS b, strlen(documents.text) AS n FROM documents),
cuts AS (
  SELECT doc_id, b, n, 0 AS i, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS e FROM b WHERE n > 0
  UNION ALL
  SELECT doc_id, b, n, i + 1, e, CAST(CASE WHEN n - e <= {size} THEN n ELSE coalesce({place}, n) END AS BIGINT)
  FROM (SELECT *, substr(b, CAST(e + 1 AS INTEGER), {size}) AS w, substr(b, CAST(e + {size + 1} AS INTEGER)) AS rest FROM cuts WHERE e < n))
SELECT doc_id, CAST(i - 1 AS BIGINT) AS chunk_index, s AS start_index, e AS end_index FROM cuts WHERE i > 0"""


def bytes_patterns_sql(size: int) -> str:
    """Before the last newline, '. ', 'tion ', 'é' or 'ß ' of a window, or the first one after it."""
    e, ss = "chr(1) || chr(2)", "chr(3) || chr(4)"
    found = r"\. |tion |\x01\x02|\x03\x04 "
    pieces = f"regexp_extract_all(w, '(?s)(.*?(?:{found}))', 1)"
    end = f"length(array_to_string({pieces}, ''))"
    newline = "length(regexp_extract(w, '(?s)^.+\\n')) - 1"
    last = f"{end} - length(regexp_extract({pieces}[len({pieces})], '({found})$', 1))"
    inside = f"nullif(greatest(0, {newline}, CASE WHEN len({pieces}) > 0 THEN {last} ELSE 0 END), 0)"
    later = ", ".join(f"coalesce(nullif(strpos(rest, {x}), 0), 1000000000)" for x in ("chr(10)", "'. '", "'tion '", f"{e}", f"{ss} || ' '"))
    after = f"nullif(least({later}), 1000000000)"
    return _cuts(one_byte_each("text", {"é": e, "ß": ss}), size, f"e + coalesce({inside}, {size} + {after} - 1)")


def bytes_consecutive_sql(size: int) -> str:
    """Before the last run of spaces that opens in a window, or the first one after it."""
    inside = "nullif(length(regexp_extract(w, '(?s)^.*[^ ] ')) - 1, -1)"
    skip = "length(regexp_extract(substr(b, CAST(e + 1 AS INTEGER)), '^ *'))"
    begin = f"greatest({size}, {skip})"
    after = f"nullif(length(regexp_extract(substr(b, CAST(e + {begin} AS INTEGER)), '(?s)^(.*?[^ ]) ', 1)), 0)"
    return _cuts(one_byte_each("text"), size, f"e + coalesce({inside}, {begin} - 1 + {after})")


def code_sql(size: int) -> str:
    """Blocks of lines by the family that each text seems to be of, joined up to so many bytes; what is larger is cut at lines."""
    count = lambda sign: f"(strlen(s) - strlen(replace(s, '{sign}', '')))"
    left, right = (f"regexp_replace(s, '{x}', '')" for x in ("^" + WHITE[1:-1], WHITE[1:-1] + "$"))
    return f"""
WITH RECURSIVE lines AS (
  SELECT doc_id, i, s[i] AS s, len(s) AS n, regexp_full_match(s[i], {WHITE}) AS blank
  FROM (SELECT doc_id, regexp_extract_all(text, '([^\\n]*\\n|[^\\n]+$)', 1) AS s FROM documents WHERE NOT regexp_full_match(text, {WHITE})), unnest(range(1, len(s) + 1)) AS r(i)),
family AS (
  SELECT doc_id, CASE WHEN braces >= 2 AND braces >= signs THEN 'braces' WHEN signs > 0 THEN 'indent' ELSE 'generic' END AS f, {size} * greatest(1, bytes // chars) AS most
  FROM (SELECT doc_id, sum({count("{")}) AS braces, CAST(sum(strlen(s)) AS BIGINT) AS bytes, CAST(sum(length(s)) AS BIGINT) AS chars,
               sum(CASE WHEN regexp_matches({left}, '^(def |class |import |from )') THEN 1 ELSE 0 END + CASE WHEN regexp_matches({right}, ':$') THEN 1 ELSE 0 END) AS signs FROM lines GROUP BY doc_id)),
ends AS (
  SELECT doc_id, i, s, f, most, CASE WHEN NOT lead(blank) OVER w AND (blank OR (f = 'braces' AND sum({count("{")} - {count("}")}) OVER w <= 0)
         OR (f = 'indent' AND NOT regexp_matches(lead(s) OVER w, '^[ \\t]'))) THEN 1 ELSE 0 END AS cut
  FROM lines JOIN family USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (SELECT doc_id, i, s, most, sum(cut) OVER (PARTITION BY doc_id ORDER BY i) - cut AS b FROM ends),
blocks AS (SELECT doc_id, b, most, string_agg(s, '' ORDER BY i) AS s, min(i) AS i, sum(strlen(s)) > most AS large FROM numbered GROUP BY doc_id, b, most),
runs AS (SELECT *, 2 * sum(CASE WHEN large THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY b) + CASE WHEN large THEN 0 ELSE 1 END AS g FROM blocks),
units AS (
  SELECT doc_id, g, most, i, s FROM runs WHERE NOT large
  UNION ALL SELECT l.doc_id, r.g, r.most, l.i, l.s FROM runs AS r JOIN numbered AS l ON r.doc_id = l.doc_id AND r.b = l.b WHERE r.large),
sums AS (SELECT *, CAST(sum(strlen(s)) OVER (PARTITION BY doc_id, g ORDER BY i) AS BIGINT) AS t FROM units),
src AS (SELECT doc_id, g, most, list(s ORDER BY i) AS m, list_prepend(0, list(t ORDER BY i)) AS t FROM sums GROUP BY doc_id, g, most),
packed AS (
  SELECT doc_id, g, most, t, 0 AS k, CAST(0 AS BIGINT) AS a, CAST(greatest(1, len(list_filter(t[2:], lambda x: x <= most))) AS BIGINT) AS z FROM src
  UNION ALL
  SELECT doc_id, g, most, t, k + 1, z, CAST(greatest(z + 1, z + len(list_filter(t[z + 2:], lambda x: x <= t[z + 1] + most))) AS BIGINT) FROM packed WHERE z < len(t) - 1),
chunks AS (SELECT p.doc_id, row_number() OVER (PARTITION BY p.doc_id ORDER BY p.g, k) - 1 AS i, array_to_string(m[a + 1:z], '') AS text FROM packed AS p JOIN src AS s ON p.doc_id = s.doc_id AND p.g = s.g)
SELECT doc_id, CAST(i AS BIGINT) AS chunk_index, CAST(sum(strlen(text)) OVER w - strlen(text) AS BIGINT) AS start_index, CAST(sum(strlen(text)) OVER w AS BIGINT) AS end_index,
       CAST(length(text) AS BIGINT) AS token_count, text FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY i)"""
