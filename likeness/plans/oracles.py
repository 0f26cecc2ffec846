"""Plain SQL for the registered queries, to check their results in another engine.

The statements work on whole tables, one step after the other, and share common table expressions.
"""

from __future__ import annotations

from likeness.functions import text as tx
from likeness.operators import structure
from likeness.operators.similarity import FEATURE_KEYS, PAIR_KEYS
from likeness.plans.tables import CODE_REWRITES


def lit(value: str) -> str:
    """An SQL string; line breaks are spelled out."""
    quoted = "'" + value.replace("'", "''") + "'"
    return quoted.replace("\n", "' || chr(10) || '")


# The other engine's regular expressions know no possessive quantifiers, nor need them.
TOKEN = tx.TOKEN_PATTERN.replace("++)", "@@").replace("]++|", "]|").replace(")*+", ")*").replace("@@", "++)")
COMMENT = tx.COMMENT_PATTERN


def drop(text: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({text}, {lit(pattern)}, {lit(by)}, 'g')"


def tokens_of(text: str) -> str:
    return f"regexp_extract_all({drop(text, COMMENT)}, {lit(TOKEN)}, 0)"


def words_of(text: str) -> str:
    return f"regexp_extract_all({normalized(text)}, {lit(tx.WORD_PATTERN)}, 0)"


def normalized(text: str) -> str:
    spaced = drop(drop(drop(text, tx.LINE_COMMENT_PATTERN), tx.BLOCK_COMMENT_PATTERN), tx.SPACE_RUN_PATTERN, " ")
    return f"trim({spaced}, ' ')"


def code_text(text: str) -> str:
    for old, new in CODE_REWRITES:
        text = f"replace({text}, {lit(old)}, {lit(new)})"
    return f"'{{ ' || {text} || ' }}'"


def words(names) -> str:
    return ", ".join(lit(n) for n in names)


def token_rows(source: str, key: str = "doc_id") -> str:
    return (
        f"SELECT {key}, generate_subscripts(tokens, 1) - 1 AS pos, unnest(tokens) AS token "
        f"FROM (SELECT {key}, {tokens_of('text')} AS tokens FROM {source})"
    )


KNOWN = {w: c for w, c in structure.WORD_CODES.items()}
CODE_CASE = " ".join(f"WHEN token = {lit(w)} THEN {lit(c)}" for w, c in KNOWN.items())
ELEMENT = drop("token", r"(\[\])+$")

CTE = {
    "docs": "SELECT doc_id, lang || '/' || source AS case_id, lang, text FROM documents",
    "code": f"SELECT doc_id, case_id, {code_text('text')} AS text FROM docs",
    "tok": token_rows("docs"),
    "ctok": token_rows("code"),
    "tc": "SELECT doc_id, token, count(*) AS cnt FROM tok GROUP BY ALL",
    "ctc": "SELECT doc_id, token, count(*) AS cnt FROM ctok GROUP BY ALL",
    "tn": """SELECT d.doc_id, coalesce(sum(cnt), 0)::BIGINT AS n, count(cnt)::BIGINT AS u
             FROM docs d LEFT JOIN tc USING (doc_id) GROUP BY 1""",
    # structure
    "classes": f"""
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn, c FROM (
          SELECT doc_id, pos, CASE {CODE_CASE}
            WHEN token LIKE '%]' AND (substr(token, 1, 1) BETWEEN 'A' AND 'Z'
                 OR {ELEMENT} IN ({words(structure.PRIMITIVE_TYPES)})) THEN 'y'
            WHEN token LIKE '%]' AND length(token) > 1 THEN 'x'
            WHEN substr(token, 1, 1) BETWEEN 'A' AND 'Z' THEN 'u'
            WHEN substr(token, 1, 1) BETWEEN 'a' AND 'z' OR substr(token, 1, 1) = '_' THEN 'a'
            ELSE 'x' END AS c
          FROM ctok) WHERE c <> ''""",
    "near": """
        SELECT *, lag(c) OVER w AS p1, lead(c) OVER w AS n1, lead(c, 2) OVER w AS n2,
          coalesce(sum(CASE c WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER before, 0) AS parens,
          coalesce(sum(CASE c WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END) OVER before, 0) AS depth,
          last_value(CASE WHEN c IN ('k', '{', '}', '(', ')', ';') THEN c END IGNORE NULLS) OVER before = 'k' AS in_class
        FROM classes
        WINDOW w AS (PARTITION BY doc_id ORDER BY rn),
               before AS (PARTITION BY doc_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "heads": """
        SELECT *, c = '{' AND coalesce(p1 IN ('=', 'y', ','), false) AS init,
          last_value(CASE WHEN c = '(' AND parens <= 0 THEN coalesce(p1 IN ('q', 'f', 'w'), false) END IGNORE NULLS)
            OVER (PARTITION BY doc_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS head
        FROM near""",
    "marks": """
        SELECT *, parens <= 0 AND c NOT IN ('{', '}', ';', ')', 'h', 'n') AS can_start,
          p1 IS NULL OR (p1 IN ('{', '}', ';') AND NOT lag(init) OVER (PARTITION BY doc_id ORDER BY rn)) AS is_direct
        FROM heads""",
    "kinds": """
        SELECT doc_id, rn, c, depth, parens, init, in_class, is_direct AND can_start AS direct, n1,
          CASE WHEN can_start AND (is_direct OR p1 = 'h' OR (p1 = ')' AND head)) THEN
            CASE WHEN c IN ('p', 'i', 'k', 'q', 'f', 'w', 'r', 't', 's', 'j') THEN upper(c)
                 WHEN c IN ('y', 'u') AND n1 IN ('a', 'u') AND n2 = '(' THEN 'M'
                 WHEN c IN ('y', 'u') AND n1 IN ('a', 'u') AND n2 IN ('=', ',', ';') THEN 'V'
                 WHEN c IN ('a', 'u') AND n1 = '(' THEN 'L'
                 ELSE 'E' END END AS kind
        FROM marks""",
    "pieces": """
        SELECT *, CASE WHEN kind IN ('Q', 'F', 'W') OR (kind = 'T' AND n1 = '(') THEN kind || 'C'
                       WHEN kind IS NOT NULL THEN kind
                       WHEN c = '{' AND NOT init AND NOT coalesce(in_class, false) AND parens <= 0 THEN 'B' END AS piece,
          last_value(CASE WHEN kind = 'M' THEN depth END IGNORE NULLS)
            OVER (PARTITION BY doc_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS method_depth
        FROM kinds""",
    "seqs": """
        SELECT d.doc_id, coalesce(string_agg(piece, '' ORDER BY rn), '') AS kinds
        FROM code d LEFT JOIN pieces USING (doc_id) GROUP BY 1""",
    "features": f"""
        SELECT d.doc_id, any_value(t.n) AS num_tokens, any_value(t.u) AS num_unique_tokens,
          {", ".join(f"count(*) FILTER (kind = '{k}') AS {n}" for n, k in structure.COUNTED_KINDS.items())},
          count(*) FILTER (contains('{structure.STATEMENT_KINDS}', kind)) AS num_statements,
          0::BIGINT AS num_var_declarations,
          coalesce(max(CASE WHEN c = '{{' THEN depth + 1 ELSE 0 END), 0)::BIGINT AS max_depth,
          CASE WHEN count(*) FILTER (kind = 'M') > 0
            THEN count(*) FILTER (direct AND contains('{structure.BODY_KINDS}', kind) AND depth = method_depth + 1)
                 / count(*) FILTER (kind = 'M') ELSE 0.0::DOUBLE END AS avg_method_length
        FROM code d LEFT JOIN pieces USING (doc_id)
        JOIN (SELECT d.doc_id, coalesce(sum(cnt), 0)::BIGINT AS n, count(cnt)::BIGINT AS u
              FROM code d LEFT JOIN ctc USING (doc_id) GROUP BY 1) t USING (doc_id)
        GROUP BY d.doc_id""",
    # corpus
    "firsts": "SELECT case_id, min(doc_id) AS doc1 FROM docs GROUP BY 1",
    "corpus": """
        SELECT d.doc_id, d.case_id,
          CASE WHEN f.doc1 IS NOT NULL THEN 'original' WHEN quality = 1 THEN 'plagiarized'
               WHEN quality = 0 THEN 'non-plagiarized' ELSE 'unknown' END AS role,
          CASE WHEN f.doc1 IS NULL THEN quality::BIGINT END AS label
        FROM docs d LEFT JOIN firsts f ON f.doc1 = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "pairs": """
        SELECT case_id, doc1, c.doc_id AS doc2, label FROM corpus c JOIN firsts USING (case_id)
        WHERE role <> 'original'""",
    "shared_counts": """
        SELECT p.doc1, p.doc2, coalesce(sum(least(a.cnt, b.cnt)), 0)::BIGINT AS token_overlap
        FROM pairs p LEFT JOIN (tc a JOIN tc b ON a.token = b.token AND a.doc_id IN (SELECT doc1 FROM firsts))
          ON a.doc_id = p.doc1 AND b.doc_id = p.doc2
        GROUP BY 1, 2""",
    "code_shared_counts": """
        SELECT p.doc1, p.doc2, coalesce(sum(least(a.cnt, b.cnt)), 0)::BIGINT AS token_overlap
        FROM pairs p LEFT JOIN (ctc a JOIN ctc b ON a.token = b.token AND a.doc_id IN (SELECT doc1 FROM firsts))
          ON a.doc_id = p.doc1 AND b.doc_id = p.doc2
        GROUP BY 1, 2""",
    "measured": """
        SELECT p.*, token_overlap, levenshtein(s1.kinds, s2.kinds)::BIGINT AS ast_levenshtein_distance,
          CASE WHEN greatest(length(s1.kinds), length(s2.kinds)) = 0 THEN 1.0
               ELSE 1 - levenshtein(s1.kinds, s2.kinds)::DOUBLE / greatest(length(s1.kinds), length(s2.kinds)) END
            AS ast_levenshtein_similarity
        FROM pairs p JOIN code_shared_counts USING (doc1, doc2)
        JOIN seqs s1 ON s1.doc_id = doc1 JOIN seqs s2 ON s2.doc_id = doc2""",
    "scored": """
        SELECT case_id, doc1, doc2, label,
          200 * token_overlap // greatest(a.n, b.n, 1) AS votes_a,
          200 * token_overlap // greatest(least(a.n, b.n), 1) AS votes_b,
          200 * least(a.n, b.n) // greatest(a.n, b.n, 1) AS votes_c,
          200 * least(a.u, b.u) // greatest(a.u, b.u, 1) AS votes_d
        FROM pairs JOIN shared_counts USING (doc1, doc2) JOIN tn a ON a.doc_id = doc1 JOIN tn b ON b.doc_id = doc2
        WHERE label IS NOT NULL""",
    "predicted": """
        SELECT *, votes_a / 200 AS score, (votes_a / 200 > 0.3::DOUBLE)::BIGINT AS prediction,
          split_part(case_id, '/', 1) AS lang, 'L' || (doc2 % 6 + 1) AS level FROM scored""",
    "confusion": """
        SELECT count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
          count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 1 AND prediction = 1) AS tp
        FROM predicted""",
    "roc": """
        SELECT 100 - i AS step, i / 100 AS threshold,
          (SELECT count(*) FROM scored WHERE label = 1 AND votes_a * 100 >= i * 200)
            / greatest((SELECT count(*) FROM scored WHERE label = 1), 1) AS tpr,
          (SELECT count(*) FROM scored WHERE label = 0 AND votes_a * 100 >= i * 200)
            / greatest((SELECT count(*) FROM scored WHERE label = 0), 1) AS fpr
        FROM (SELECT unnest(range(101)) AS i)""",
    "simplex": """
        SELECT a, b, c, 10 - a - b - c AS d FROM
          (SELECT unnest(range(11)) AS a), (SELECT unnest(range(11)) AS b), (SELECT unnest(range(11)) AS c)
        WHERE a + b + c <= 10""",
    "tried": """
        SELECT a, b, c, d, count(*) AS n, count(*) FILTER ((a * (votes_a / 200) + b * (votes_b / 200) + c * (votes_c / 200)
          + d * (votes_d / 200) > 5.0::DOUBLE)::BIGINT = label) AS correct
        FROM scored, simplex GROUP BY ALL""",
    "best": "SELECT * FROM tried ORDER BY correct DESC, a, b, c LIMIT 1",
    "blended": """
        SELECT label, total, round(total / 10, 9) AS score FROM (
          SELECT label, a * (votes_a / 200) + b * (votes_b / 200) + c * (votes_c / 200) + d * (votes_d / 200) AS total
          FROM scored, best)""",
    # embeddings
    "words": f"""
        SELECT doc_id, list_extract(words, 1) AS first, unnest(words) AS word
        FROM (SELECT doc_id, {words_of("text")} AS words FROM documents)""",
    "word_vectors": """
        SELECT first AS word, arg_min(embedding, vec_id)::DOUBLE[] AS v
        FROM (SELECT DISTINCT doc_id AS vec_id, first FROM words) JOIN embeddings USING (vec_id) GROUP BY 1""",
    "means": """
        SELECT doc_id, dim, avg(value) AS value FROM (
          SELECT doc_id, generate_subscripts(v, 1) - 1 AS dim, unnest(v) AS value FROM words JOIN word_vectors USING (word))
        GROUP BY 1, 2""",
    # batches
    "files": """
        SELECT conv_id AS batch_id, CASE WHEN role = 'user' THEN 't' || turn || '.java'
          ELSE 'replies/t' || turn || '.java' END AS path, conv_id * 100000 + turn AS doc_id, text FROM conversations""",
}


def rates(tn: str = "tn", fp: str = "fp", fn: str = "fn", tp: str = "tp") -> str:
    precision = f"(CASE WHEN {tp} + {fp} > 0 THEN {tp} / ({tp} + {fp}) ELSE 0.0 END)"
    recall = f"(CASE WHEN {tp} + {fn} > 0 THEN {tp} / ({tp} + {fn}) ELSE 0.0 END)"
    f1 = f"(CASE WHEN {precision} + {recall} > 0 THEN 2 * {precision} * {recall} / ({precision} + {recall}) ELSE 0.0 END)"
    accuracy = f"(CASE WHEN {tn} + {fp} + {fn} + {tp} > 0 THEN ({tp} + {tn}) / ({tn} + {fp} + {fn} + {tp}) ELSE 0.0 END)"
    return ", ".join(
        f"round({e}, 6)::DOUBLE AS {n}"
        for e, n in ((accuracy, "accuracy"), (precision, "precision"), (recall, "recall"), (f1, "f1"))
    )


def auc_of(table: str, score: str) -> str:
    """Share of positive and negative pairs in the right order, ties counting half."""
    counted = f"SELECT {score} AS s, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM {table} GROUP BY 1"
    return f"""
        SELECT round(sum(pos * (2 * coalesce(below, 0) + neg)) / (2.0::DOUBLE * sum(pos) * sum(neg)), 6)::DOUBLE AS auc
        FROM (SELECT pos, neg, sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below
              FROM ({counted}))"""


def with_ctes(names: str, body: str) -> str:
    """A statement with the named common table expressions and all those they rest on."""
    needed: list[str] = []

    def visit(name: str) -> None:
        if name in needed:
            return
        text = CTE[name].replace("(", " ").replace(")", " ").replace(",", " ").split()
        for other in CTE:
            if other != name and any(a in ("FROM", "JOIN") and b == other or (a == "," and b == other) for a, b in zip(text, text[1:])):
                visit(other)
        for extra in EXTRA.get(name, []):
            visit(extra)
        needed.append(name)

    for name in names.split():
        visit(name)
    steps = ",\n".join(f"{n} AS MATERIALIZED ({CTE[n]})" for n in needed)
    return f"WITH {steps}\n{body}"


EXTRA = {
    "shared_counts": ["tc", "firsts"],
    "code_shared_counts": ["ctc", "firsts"],
    "tried": ["scored", "simplex"],
    "blended": ["scored", "best"],
}


def bags_sql(source: str) -> str:
    """Token bags of a source, and of each batch's equal bags the first document."""
    return f"""
    WITH docs AS (SELECT doc_id, lang || '/' || source AS case_id, lang, text FROM documents),
    files AS ({CTE["files"]}),
    src AS MATERIALIZED ({source}),
    t AS MATERIALIZED ({token_rows("src", "batch_id, doc_id")}),
    bag AS MATERIALIZED (SELECT batch_id, doc_id, token, count(*) AS cnt FROM t GROUP BY ALL),
    total AS MATERIALIZED (
      SELECT s.batch_id, s.doc_id, coalesce(sum(cnt), 0)::BIGINT AS n,
        coalesce(string_agg(token || chr(1) || cnt, chr(2) ORDER BY token), '') AS bag_text
      FROM src s LEFT JOIN bag USING (batch_id, doc_id) GROUP BY 1, 2),
    grouped AS MATERIALIZED (
      SELECT batch_id, bag_text, any_value(n) AS n, min(doc_id) AS doc_id, count(*) AS copies FROM total GROUP BY 1, 2)"""


def similar_sql(source: str, percent: int) -> str:
    """All pairs by brute force; equal bags are one group and stand for their members."""
    return f"""{bags_sql(source)},
    shared AS (
      SELECT g.batch_id, g.doc_id AS doc1, h.doc_id AS doc2, g.copies AS copies1, h.copies AS copies2,
        g.n AS num_tokens1, h.n AS num_tokens2, sum(least(a.cnt, b.cnt))::BIGINT AS token_overlap
      FROM grouped g JOIN bag a ON a.batch_id = g.batch_id AND a.doc_id = g.doc_id
      JOIN bag b ON b.batch_id = g.batch_id AND b.token = a.token
      JOIN grouped h ON h.batch_id = b.batch_id AND h.doc_id = b.doc_id AND g.doc_id < h.doc_id
      GROUP BY ALL),
    similar_pairs AS MATERIALIZED (
      SELECT * FROM shared WHERE token_overlap * 100 >= (num_tokens1 + num_tokens2 - token_overlap) * {percent}
      UNION ALL
      SELECT batch_id, g.doc_id, t.doc_id, copies, copies, g.n, g.n, g.n
      FROM grouped g JOIN total t USING (batch_id, bag_text) WHERE t.doc_id <> g.doc_id)
    """


def candidates_sql(percent: int, hashes: int = 40, rows: int = 2, prime: int = 2147483647) -> str:
    """Documents that agree in a band of least hash values, with all their tokens compared."""
    return f"""{bags_sql("SELECT 0 AS batch_id, doc_id, text FROM docs")},
    lists AS (SELECT doc_id, list(token ORDER BY pos) AS tokens FROM t WHERE doc_id IN (SELECT doc_id FROM grouped) GROUP BY 1),
    runs AS (SELECT DISTINCT doc_id, md5(array_to_string(tokens[i : i + 2], ' ')) AS r FROM (
      SELECT *, unnest(range(1, greatest(len(tokens) - 2, 1) + 1)) AS i FROM lists)),
    numbers AS MATERIALIZED (SELECT doc_id, ('0x' || substr(r, 1, 8))::BIGINT % {prime} AS x FROM runs),
    functions AS (SELECT h, 2654435761 * (h + 1) % {prime} AS a, 40503 * (h + 1) * (h + 1) % {prime} AS b FROM (SELECT unnest(range({hashes})) AS h)),
    least_values AS (SELECT doc_id, h, min((x * a + b) % {prime}) AS v FROM numbers, functions GROUP BY 1, 2),
    bands AS MATERIALIZED (SELECT doc_id, h // {rows} AS band, list(v ORDER BY h) AS key FROM least_values GROUP BY 1, 2),
    met AS MATERIALIZED (SELECT DISTINCT a.doc_id AS doc1, b.doc_id AS doc2 FROM bands a JOIN bands b USING (band, key) WHERE a.doc_id < b.doc_id),
    one AS MATERIALIZED (SELECT doc1, doc2, token, cnt AS cnt1 FROM met JOIN bag ON doc_id = doc1),
    other AS MATERIALIZED (SELECT doc1, doc2, token, cnt AS cnt2 FROM met JOIN bag ON doc_id = doc2),
    both_have AS (SELECT doc1, doc2, sum(least(cnt1, cnt2))::BIGINT AS token_overlap FROM one JOIN other USING (doc1, doc2, token) GROUP BY 1, 2),
    found AS MATERIALIZED (
    SELECT doc1, doc2, a.n AS num_tokens1, b.n AS num_tokens2, token_overlap, false AS is_copy
    FROM both_have JOIN grouped a ON a.doc_id = doc1 JOIN grouped b ON b.doc_id = doc2
    WHERE token_overlap * 100 >= (a.n + b.n - token_overlap) * {percent}
    UNION ALL
    SELECT g.doc_id, t.doc_id, g.n, g.n, g.n, true FROM grouped g JOIN total t USING (bag_text) WHERE t.doc_id <> g.doc_id)
    """


def snippets_sql(percent: int, shortest: int) -> str:
    """Common sections of single pairs by comparing all tokens with all; longest runs first, then what is free of the others."""
    place = lambda axis: f"list_transform(tiles, lambda t: {{'lo': t.{axis} - r[1].{axis}, 'hi': t.{axis} - r[1].{axis} + t.len}})"
    covered = f"list_filter({place('i')} || {place('j')}, lambda c: c.hi > 0 AND c.lo < r[1].len)"
    free = "list_filter(list_distinct([0::BIGINT] || list_transform(taken, lambda c: c.hi)), lambda b: b >= 0 AND b < r[1].len AND len(list_filter(taken, lambda c: c.lo <= b AND b < c.hi)) = 0)"
    stop = "coalesce(list_min(list_transform(list_filter(taken, lambda c: c.lo > b), lambda c: c.lo)), r[1].len)"
    piece = f"list_transform(list_sort({free}), lambda b: {{'i': r[1].i + b, 'j': r[1].j + b, 'len': {stop} - b}})"
    pieces = f"list_filter(list_transform([{covered}], lambda taken: {piece})[1], lambda p: p.len >= {shortest})"
    pieces_of = f"string_split({drop(f"translate({drop('text', COMMENT)}, chr(1), chr(2))", '(' + TOKEN + ')', chr(1) + chr(92) + '1' + chr(1))}, chr(1))"
    text = lambda side, axis: f"array_to_string({side}.pieces[2 * tile.{axis} + 2 : 2 * (tile.{axis} + tile.len)], '')"
    return f"""{candidates_sql(percent)},
    listed AS MATERIALIZED (
      SELECT least(x.doc_id, y.doc_id) AS doc1, greatest(x.doc_id, y.doc_id) AS doc2
      FROM found JOIN grouped g ON g.doc_id = doc1 JOIN grouped h ON h.doc_id = doc2 JOIN total x ON x.bag_text = g.bag_text JOIN total y ON y.bag_text = h.bag_text
      WHERE NOT is_copy
      UNION
      SELECT x.doc_id, y.doc_id FROM total x JOIN total y USING (bag_text) WHERE x.doc_id < y.doc_id),
    firsts AS MATERIALIZED (SELECT doc1, doc2, pos::BIGINT AS i, token FROM listed JOIN t ON doc_id = doc1),
    seconds AS MATERIALIZED (SELECT doc1, doc2, pos::BIGINT AS j, token FROM listed JOIN t ON doc_id = doc2),
    cells AS MATERIALIZED (SELECT doc1, doc2, i, j FROM firsts JOIN seconds USING (doc1, doc2, token)),
    common AS MATERIALIZED (
      SELECT doc1, doc2, min(i) AS i, min(j) AS j, count(*) AS len
      FROM (SELECT *, i - row_number() OVER (PARTITION BY doc1, doc2, j - i ORDER BY i) AS run FROM cells)
      GROUP BY doc1, doc2, j - i, run HAVING count(*) >= {shortest}),
    tiled AS MATERIALIZED (
      SELECT doc1, doc2, list_reduce([[]::STRUCT(i BIGINT, j BIGINT, len BIGINT)[]] || list([{{'i': i, 'j': j, 'len': len}}] ORDER BY len DESC, i, j),
        lambda tiles, r: tiles || {pieces}) AS tiles FROM common GROUP BY 1, 2),
    sections AS (
      SELECT doc1, doc2, generate_subscripts(tiles, 1) AS section, unnest(tiles) AS tile FROM (SELECT doc1, doc2, list_sort(tiles) AS tiles FROM tiled)),
    cut AS (SELECT doc_id, {pieces_of} AS pieces FROM src)
    SELECT doc1, doc2, section, tile.i AS start1, tile.i + tile.len AS end1, tile.j AS start2, tile.j + tile.len AS end2,
      {text("a", "i")} AS text1, {text("b", "j")} AS text2
    FROM sections JOIN cut a ON a.doc_id = doc1 JOIN cut b ON b.doc_id = doc2"""


BATCH_SOURCE = "SELECT batch_id, doc_id, text FROM files"
TOP_FILE = "NOT contains(path, '/') AND path LIKE '%.java'"
COMPARISONS = (
    similar_sql(BATCH_SOURCE, 20)
    + """, comparisons AS (
      SELECT batch_id, 't' || (doc1 % 100000) || '.java' AS file1, 't' || (doc2 % 100000) || '.java' AS file2,
        CASE WHEN greatest(num_tokens1, num_tokens2) > 0 THEN votes / 200 END AS p1,
        CASE WHEN greatest(num_tokens1, num_tokens2) > 0 THEN (votes >= 100)::BIGINT END AS prediction
      FROM (SELECT *, 200 * token_overlap // greatest(num_tokens1, num_tokens2, 1) AS votes FROM similar_pairs)),
    listed AS (
      SELECT batch_id, n AS total_files, (n * (n - 1) // 2)::BIGINT AS total_comparisons,
        CASE WHEN n < 2 THEN 'ZIP must contain at least 2 Java files' END AS error
      FROM (SELECT batch_id, count(*) AS n FROM files GROUP BY 1)),
    -- Every two files of a batch, copies or not, with the tokens they share.
    each_pair AS (
      SELECT x.batch_id, greatest(x.n, y.n) AS larger,
        coalesce((SELECT sum(least(a.cnt, b.cnt)) FROM bag a JOIN bag b USING (batch_id, token)
          WHERE a.batch_id = x.batch_id AND a.doc_id = x.doc_id AND b.doc_id = y.doc_id), 0) AS in_both,
        x.n + y.n AS sizes
      FROM total x JOIN total y ON x.batch_id = y.batch_id AND x.doc_id < y.doc_id),
    copied AS (
      SELECT batch_id, count(*)::BIGINT AS plagiarized_pairs FROM each_pair
      WHERE larger > 0 AND in_both * 100 >= (sizes - in_both) * 20 AND 200 * in_both // larger >= 100 GROUP BY 1)
    """
)

LABELLED = "SELECT doc_id, quality::BIGINT AS label FROM labels"


def split_sql(seed: int, name: str, condition: str, group: str = "") -> str:
    part = f"PARTITION BY {group}" if group else ""
    return f"""
    SELECT doc_id, label, {condition} AS {name} FROM (
      SELECT *, row_number() OVER ({part} ORDER BY md5('{seed}|' || doc_id), doc_id) AS rank,
        count(*) OVER ({part}) AS size FROM ({LABELLED}))"""


def path_sql() -> str:
    path = """
      SELECT doc_id, 'corpus/case-' || replace(case_id, '/', '-') || CASE role
        WHEN 'original' THEN '/original/' || doc_id || '.java'
        WHEN 'non-plagiarized' THEN '/non-plagiarized/' || doc_id || '/Main.java'
        ELSE '/plagiarized/L' || (doc_id % 6 + 1) || '/' || doc_id || '/Main.java' END AS path FROM corpus"""
    return with_ctes(
        "corpus",
        f"""SELECT doc_id, path, split_part(path, '/', 2) AS case_id, role,
          CASE role WHEN 'non-plagiarized' THEN 0 WHEN 'plagiarized' THEN 1 END::BIGINT AS label,
          CASE WHEN role <> 'original' THEN split_part(path, '/', -3) END AS level
        FROM (SELECT *, CASE WHEN contains(path, '/original/') THEN 'original'
                WHEN contains(path, 'non-plagiarized') THEN 'non-plagiarized' ELSE 'plagiarized' END AS role
              FROM ({path}))""",
    )


def ngram_sql(n: int) -> str:
    names = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in structure.KIND_NAMES.items())
    gram = " || '_' || ".join(f"CASE substr(code, {i + 1}, 1) {names} END" for i in range(n))
    return with_ctes(
        "seqs",
        f"""SELECT doc_id, {gram} AS gram, count(*) AS cnt FROM (
          SELECT doc_id, substr(kinds, i, {n}) AS code
          FROM (SELECT doc_id, kinds, unnest(range(1, length(kinds) - {n - 2})) AS i FROM seqs))
        GROUP BY doc_id, code""",
    )


def named_sql() -> str:
    def count(code: str) -> str:
        return f"len(list_filter(range(1, length(kinds) + 1), lambda i: substr(kinds, i, {len(code)}) = '{code}'))"

    columns = ", ".join(f"{count(code)}::BIGINT AS {name}" for name, code in structure.NAMED_NGRAMS.items())
    return with_ctes("seqs", f"SELECT doc_id, {columns} FROM seqs")


def vector_sql() -> str:
    def side(number: int) -> list[str]:
        return [
            f"printf('%.10f', {'m.' + k if k in PAIR_KEYS else f'f{number}.' + k}::DOUBLE)" for k in FEATURE_KEYS
        ]

    both = ", ".join(side(1) + side(2))
    return with_ctes(
        "measured features",
        f"""SELECT m.doc1, m.doc2, m.label, {2 * len(FEATURE_KEYS)}::BIGINT AS width,
          array_to_string([{both}], ',') AS features
        FROM measured m JOIN features f1 ON f1.doc_id = doc1 JOIN features f2 ON f2.doc_id = doc2""",
    )


def negative_rows() -> str:
    """Draws as documented: one of each part of all candidates in hash order but those of the own case."""
    number = lambda x, digits: f"('0x' || substr(md5({x}), 1, {digits}))::BIGINT"
    case = "'43|' || case_id"
    return f"""
      ranked AS (
        SELECT doc_id AS doc2, case_id AS case2,
          row_number() OVER (ORDER BY {number(case, 8)} % 64, md5({case}), case_id, md5('43|' || doc_id), doc_id) - 1 AS place
        FROM corpus WHERE role = 'non-plagiarized'),
      stretch AS (SELECT case2 AS case_id, min(place) AS start, count(*) AS own FROM ranked GROUP BY 1),
      origs AS (
        SELECT doc_id AS doc1, c.case_id, coalesce(start, 0) AS start, coalesce(own, 0) AS own,
          (SELECT count(*) FROM ranked) - coalesce(own, 0) AS others
        FROM corpus c LEFT JOIN stretch USING (case_id) WHERE role = 'original'),
      draws AS (SELECT *, least(5, others) AS parts, unnest(range(least(5, others))) AS i FROM origs),
      spots AS (
        SELECT *, (i * others // parts + {number("'42|draw|' || doc1 || '|' || i", 15)} % ((i + 1) * others // parts - i * others // parts)
          + {number("'42|from|' || doc1", 15)} % others) % others AS spot FROM draws),
      negatives AS (
        SELECT case_id, doc1, doc2, 0::BIGINT AS label FROM spots
        JOIN ranked ON place = CASE WHEN spot < start THEN spot ELSE spot + own END)"""


POSITIVES = "SELECT case_id, doc1, doc2, 1::BIGINT AS label FROM pairs WHERE label = 1"


def oracle_sql() -> dict[str, str]:
    predicted = lambda body: with_ctes("predicted", body)
    return {
        "label_from_path": path_sql(),
        "load_batch": with_ctes(
            "files",
            """SELECT batch_id, total_files, CASE WHEN total_files < 2 THEN 'ZIP must contain at least 2 Java files' END AS error
            FROM (SELECT batch_id, count(*) FILTER (NOT contains(path, '/') AND path LIKE '%.java') AS total_files
                  FROM files GROUP BY 1)""",
        ),
        "bootstrap": """
            WITH ranked AS (SELECT doc_id, quality::BIGINT AS label, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) AS rank,
                count(*) OVER () AS n FROM labels),
              draws AS (SELECT ('0x' || substr(md5('42|draw|' || i), 1, 15))::BIGINT AS draw
                FROM (SELECT unnest(range((SELECT floor(0.8 * count(*) + 0.5)::BIGINT FROM labels))) AS i))
            SELECT doc_id, label FROM draws JOIN ranked ON rank = draw % n + 1""",
        "read_pairs": """SELECT label::BIGINT AS label, len(embedding)::BIGINT AS width,
            array_to_string(list_transform(embedding, lambda x: printf('%.8f', x::DOUBLE)), ',') AS features FROM embeddings""",
        "load_corpus": """SELECT 'case-' || item_id AS case_id, 'original' AS role, NULL::BIGINT AS label, NULL::VARCHAR AS level,
            strlen(text) + 1 AS n_bytes, md5(text || chr(10)) AS text_md5 FROM benchmark""",
        "approximate_token_numbers": with_ctes(
            "tok docs",
            "SELECT lang, count(DISTINCT token) AS num_unique_tokens, true AS within_bound FROM tok JOIN docs USING (doc_id) GROUP BY 1",
        ),
        "strip_comments": f"SELECT page_id, {drop('url', COMMENT)} AS url, md5({drop('html', COMMENT)}) AS html_md5 FROM pages",
        "normalize_code": with_ctes("code", f"SELECT doc_id, md5({normalized('text')}) AS text_md5 FROM code"),
        "tokenize": with_ctes(
            "code", f"SELECT doc_id, md5(coalesce(array_to_string({tokens_of('text')}, ' '), '')) AS tokens_md5 FROM code"
        ),
        "word_tokens": f"""SELECT doc_id, len(words)::BIGINT AS num_words, md5(coalesce(array_to_string(words, ' '), '')) AS words_md5
            FROM (SELECT doc_id, {words_of('text')} AS words FROM documents)""",
        "token_positions": with_ctes("tok", "SELECT doc_id, pos::BIGINT AS pos, token FROM tok"),
        "token_counts": with_ctes("tc", "SELECT * FROM tc"),
        "token_numbers": with_ctes("tn", "SELECT doc_id, n AS num_tokens, u AS num_unique_tokens FROM tn"),
        "token_context": with_ctes(
            "ctok",
            """SELECT doc_id, pos::BIGINT AS pos, token, lag(token) OVER w AS prev, lead(token) OVER w AS next,
              sum(CASE token WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END) OVER w::BIGINT AS brace_depth,
              sum(CASE token WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER w::BIGINT AS paren_depth
            FROM ctok WINDOW w AS (PARTITION BY doc_id ORDER BY pos)""",
        ),
        "statement_kinds": with_ctes(
            "kinds",
            """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY rn) AS stmt, kind, depth::BIGINT AS depth
            FROM kinds WHERE kind IS NOT NULL""",
        ),
        "doc_features": with_ctes(
            "features",
            "SELECT * REPLACE (round(avg_method_length, 6)::DOUBLE AS avg_method_length) FROM features",
        ),
        "kind_sequence": with_ctes("seqs", "SELECT * FROM seqs"),
        "kind_ngrams_2": ngram_sql(2),
        "kind_ngrams_4": ngram_sql(4),
        "named_ngrams": named_sql(),
        "case_pairs": with_ctes("pairs", "SELECT * FROM pairs"),
        "positive_pairs": with_ctes("pairs", POSITIVES),
        "negative_pairs": with_ctes("corpus", "").rstrip() + "," + negative_rows() + " SELECT * FROM negatives",
        "training_pairs": with_ctes("pairs", "").rstrip()
        + ","
        + negative_rows()
        + f""" SELECT *, md5('42|' || doc1 || '|' || doc2) AS turn FROM ({POSITIVES} UNION ALL SELECT * FROM negatives)""",
        "one_pair": with_ctes(
            "tn tc",
            """SELECT min(doc_id) AS doc1, max(doc_id) AS doc2,
              arg_min(n, doc_id) AS num_tokens1, arg_max(n, doc_id) AS num_tokens2,
              arg_min(u, doc_id) AS num_unique_tokens1, arg_max(u, doc_id) AS num_unique_tokens2,
              (SELECT coalesce(sum(least(a.cnt, b.cnt)), 0)::BIGINT FROM tc a JOIN tc b USING (token)
               WHERE a.doc_id = (SELECT min(doc_id) FROM docs) AND b.doc_id = (SELECT max(doc_id) FROM docs)) AS token_overlap
            FROM tn""",
        ),
        "batch_pairs": similar_sql(BATCH_SOURCE, 30) + "SELECT * FROM similar_pairs",
        "case_near_copies": similar_sql("SELECT case_id AS batch_id, doc_id, text FROM docs", 60)
        + "SELECT * FROM similar_pairs",
        "candidate_pairs": candidates_sql(75) + "SELECT * FROM found",
        "overlap_snippets": snippets_sql(75, 12),
        "token_overlap": with_ctes(
            "shared_counts tn",
            """SELECT doc1, doc2, case_id, token_overlap, a.n AS num_tokens1, b.n AS num_tokens2,
              a.u AS num_unique_tokens1, b.u AS num_unique_tokens2
            FROM pairs JOIN shared_counts USING (doc1, doc2) JOIN tn a ON a.doc_id = doc1 JOIN tn b ON b.doc_id = doc2""",
        ),
        "sequence_measures": with_ctes(
            "measured",
            """SELECT case_id, doc1, doc2, token_overlap, ast_levenshtein_distance,
              round(ast_levenshtein_similarity, 6)::DOUBLE AS ast_levenshtein_similarity FROM measured""",
        ),
        "pair_vector": vector_sql(),
        "feature_keys": """
            SELECT row_number() OVER (ORDER BY doc, place) - 1 AS pos, name FROM (
              SELECT name, min(doc_id) AS doc, arg_min(place, doc_id) AS place FROM (
                SELECT doc_id, 0 AS place, 'n_chars' AS name FROM documents
                UNION ALL SELECT doc_id, 1, 'lang_' || lang FROM documents
                UNION ALL SELECT doc_id, 2, 'source_' || source FROM documents) GROUP BY name)""",
        "cosine_similarity": """
            SELECT f.doc1, e.vec_id AS doc2, round(CASE WHEN list_dot_product(a.v, a.v) = 0 OR list_dot_product(e.v, e.v) = 0 THEN 0.0
              ELSE list_dot_product(a.v, e.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(e.v, e.v))) END, 6)::DOUBLE AS cosine
            FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings) e
            JOIN (SELECT label, min(vec_id) AS doc1 FROM embeddings GROUP BY 1) f USING (label)
            JOIN (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) a ON a.vec_id = f.doc1""",
        "random_split": split_sql(7, "is_train", "rank <= size * 80 // 100"),
        "seeded_split": split_sql(42, "is_train", "rank <= size * 80 // 100"),
        "stratified_split": split_sql(42, "is_train", "rank <= size * 80 // 100", "label"),
        "validation_split": split_sql(42, "is_validation", "rank > size * 80 // 100"),
        "stratified_folds": split_sql(42, "fold", "(rank - 1) % 5", "label"),
        "confusion_matrix": with_ctes("confusion", "SELECT * FROM confusion"),
        "binary_metrics": with_ctes("confusion", f"SELECT *, {rates()} FROM confusion"),
        "classification_report": predicted(
            """, classes AS (
              SELECT class, sum(support) AS support, sum(hits) AS hits, sum(chosen) AS chosen FROM (
                SELECT label AS class, 1 AS support, (label = prediction)::BIGINT AS hits, 0 AS chosen FROM predicted
                UNION ALL SELECT prediction, 0, 0, 1 FROM predicted) GROUP BY 1),
            rated AS (
              SELECT *, CASE WHEN chosen > 0 THEN hits / chosen ELSE 0.0 END AS p,
                CASE WHEN support > 0 THEN hits / support ELSE 0.0 END AS r FROM classes),
            scores AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f FROM rated),
            report AS (
              SELECT class::VARCHAR AS name, p, r, f, support FROM scores
              UNION ALL SELECT 'accuracy', NULL, NULL, sum(hits) / sum(support), sum(support) FROM scores
              UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(support) FROM scores
              UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support),
                sum(f * support) / sum(support), sum(support) FROM scores)
            SELECT name, round(p, 6)::DOUBLE AS precision, round(r, 6)::DOUBLE AS recall, round(f, 6)::DOUBLE AS f1,
              support::BIGINT AS support FROM report"""
        ),
        "roc_points": with_ctes(
            "roc",
            """SELECT step::BIGINT AS step, round(threshold, 6)::DOUBLE AS threshold, round(tpr, 6)::DOUBLE AS tpr,
              round(fpr, 6)::DOUBLE AS fpr FROM roc""",
        ),
        "auc_trapezoid": with_ctes(
            "roc",
            """SELECT round(coalesce(sum((fpr - f) * (tpr + t) / 2), 0), 6)::DOUBLE AS auc FROM (
              SELECT *, lag(fpr) OVER (ORDER BY step) AS f, lag(tpr) OVER (ORDER BY step) AS t FROM roc)""",
        ),
        "auc_rank": with_ctes("scored", auc_of("scored", "votes_a")),
        "evaluate_by_group": predicted(
            f"""SELECT *, {rates()} FROM (
              SELECT lang, level, grouping(lang, level)::BIGINT AS grouping,
                count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
                count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 1 AND prediction = 1) AS tp
              FROM predicted GROUP BY CUBE (lang, level))"""
        ),
        "sort_scores": predicted("SELECT doc1, doc2, round(score, 6)::DOUBLE AS score FROM predicted ORDER BY score DESC"),
        "class_weights": f"""SELECT l.label, doc_id, round(total / (classes * n), 6)::DOUBLE AS weight FROM ({LABELLED}) l
            JOIN (SELECT quality::BIGINT AS label, count(*) AS n FROM labels GROUP BY 1) c USING (label),
            (SELECT count(*) AS total, count(DISTINCT quality) AS classes FROM labels)""",
        "vote_predict": with_ctes(
            "scored",
            """SELECT doc1, doc2, (votes_c >= 100)::BIGINT AS serving, (votes_c > 100)::BIGINT AS evaluating FROM scored""",
        ),
        "threshold_predict": with_ctes("scored", "SELECT doc1, doc2, (votes_c > 100)::BIGINT AS prediction FROM scored"),
        "blend": with_ctes(
            "scored",
            """SELECT doc1, doc2, label, round(total / 10, 6)::DOUBLE AS score, (total > 5.0::DOUBLE)::BIGINT AS prediction
            FROM (SELECT *, 1 * (votes_a / 200) + 2 * (votes_b / 200) + 3 * (votes_c / 200) + 4 * (votes_d / 200) AS total
                  FROM scored)""",
        ),
        "weight_accuracy": with_ctes("tried", "SELECT *, round(correct / n, 6)::DOUBLE AS accuracy FROM tried"),
        "best_weights": with_ctes("best", "SELECT *, round(correct / n, 6)::DOUBLE AS accuracy FROM best"),
        "best_blend": with_ctes(
            "blended",
            f"""SELECT accuracy, f1, auc FROM (SELECT {rates()} FROM (
              SELECT count(*) FILTER (label = 0 AND p = 0) AS tn, count(*) FILTER (label = 0 AND p = 1) AS fp,
                count(*) FILTER (label = 1 AND p = 0) AS fn, count(*) FILTER (label = 1 AND p = 1) AS tp
              FROM (SELECT label, (total > 5.0::DOUBLE)::BIGINT AS p FROM blended))), ({auc_of("blended", "score")})""",
        ),
        "doc_embedding": with_ctes(
            "means",
            """SELECT d.doc_id, i::BIGINT AS dim, round(coalesce(value, 0), 6)::DOUBLE AS value
            FROM documents d CROSS JOIN (SELECT unnest(range(64)) AS i) LEFT JOIN means m ON m.doc_id = d.doc_id AND m.dim = i""",
        ),
        "nn_pair_vector": with_ctes(
            "means pairs",
            """, norms AS (SELECT doc_id, sqrt(sum(value * value)) AS norm FROM means GROUP BY 1),
            cosines AS (
              SELECT p.doc1, p.doc2, sum(x.value * y.value) / (any_value(a.norm) * any_value(b.norm)) AS cosine FROM pairs p
              JOIN means x ON x.doc_id = p.doc1 JOIN means y ON y.doc_id = p.doc2 AND x.dim = y.dim
              JOIN norms a ON a.doc_id = p.doc1 JOIN norms b ON b.doc_id = p.doc2 GROUP BY 1, 2),
            cells AS (SELECT doc1, doc2, unnest(range(129)) AS dim FROM pairs)
            SELECT c.doc1, c.doc2, c.dim::BIGINT AS dim, round(coalesce(CASE WHEN c.dim = 128 THEN cosine ELSE m.value END, 0), 6)::DOUBLE AS value
            FROM cells c LEFT JOIN cosines s ON s.doc1 = c.doc1 AND s.doc2 = c.doc2
            LEFT JOIN means m ON m.doc_id = CASE WHEN c.dim < 64 THEN c.doc1 ELSE c.doc2 END AND m.dim = c.dim % 64 AND c.dim < 128""",
        ),
        "batch_report": COMPARISONS
        + """SELECT l.batch_id, total_files, total_comparisons, 20::BIGINT AS threshold, error, file1, file2, prediction, round(p1, 6)::DOUBLE AS p1
            FROM listed l LEFT JOIN comparisons c ON c.batch_id = l.batch_id""",
        "report_summary": COMPARISONS
        + """SELECT l.batch_id, total_files, count(file1) AS listed,
              coalesce(any_value(plagiarized_pairs), 0)::BIGINT AS plagiarized_pairs, total_comparisons, error
            FROM listed l LEFT JOIN comparisons c ON c.batch_id = l.batch_id
            LEFT JOIN copied d ON d.batch_id = l.batch_id GROUP BY l.batch_id, total_files, total_comparisons, error""",
        "plagiarized_pairs": COMPARISONS
        + """SELECT batch_id, file1, file2, 'Plagiarized' AS status, printf('%.1f%%', p1 * 100) AS confidence
            FROM comparisons WHERE prediction = 1""",
        "status_and_confidence": predicted(
            """SELECT doc1, doc2, CASE WHEN prediction = 1 THEN 'Plagiarized' ELSE 'Not Plagiarized' END AS status,
              CASE WHEN doc2 % 7 <> 0 THEN printf('%.1f%%', score * 100) ELSE 'No confidence score available.' END AS batch_confidence,
              CASE WHEN doc2 % 7 <> 0 THEN printf('%.2f%%', score * 100) ELSE 'No confidence score available.' END AS single_confidence
            FROM predicted"""
        ),
        "report_history": """
            SELECT *, round(p1 - previous_p1, 6)::DOUBLE AS change FROM (
              SELECT submitted_at, file1, file2, (p1 > 0.5::DOUBLE)::BIGINT AS prediction, p1,
                lag(p1) OVER (PARTITION BY file1, file2 ORDER BY submitted_at) AS previous_p1
              FROM (SELECT 1700000000 + conv_id * 86400 AS submitted_at, 't' || turn || '.java' AS file1, role || '.java' AS file2,
                      round((length(text) % 200) / 200, 6)::DOUBLE AS p1 FROM conversations))""",
        "row_errors": """
            SELECT d.doc_id, quality::BIGINT AS prediction,
              CASE WHEN quality IS NOT NULL THEN round((n_chars % 200) / 200, 6)::DOUBLE END AS p1,
              CASE WHEN quality IS NULL THEN 'no label' END AS error
            FROM documents d LEFT JOIN labels USING (doc_id)""",
    }
