"""One query for each operator, over whole tables, with the SQL that says the same where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspan.llm import decontamination, fingerprints, html_text, languages, near_duplicates, quality, ranked_search, sentence_pieces, spelling, token_counts, token_files, toxicity, url_filter
from cohortspan.llm.common import in_split, ship_code
from cohortspan.sources.staging import session_dir

URL_RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.cluster(_table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def proximity_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.proximity_matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).selectExpr(
        "doc_id", "item_id", "CAST(begin AS bigint) AS begin_word", "CAST(end AS bigint) AS end_word"
    )


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(_table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = in_split("doc_id", 4, 2)
    model = languages.learn(docs.where(~held_out), usual=False)
    return languages.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = in_split("doc_id", 5, 0)
    model = quality.learn(docs, labels.where(~held_out))
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = in_split("doc_id", 5, 0)
    model = toxicity.learn(docs, labels.where(~held_out))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode(_table(spark, sf_dir, "documents"), digested=True)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_tokens(spark, token_files.write_tokens(_table(spark, sf_dir, "documents")))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A cache of its own, empty at first, so that every run counts every text.
    cache = f"{session_dir(spark)}/token-counts-{uuid.uuid4().hex}"
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), cache)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_decontamination": op3_decontamination,
    "op4_fingerprints": op4_fingerprints,
    "op5_language": op5_language,
    "op6_quality": op6_quality,
    "op7_toxicity": op7_toxicity,
    "op8_sentence_pieces": op8_sentence_pieces,
    "op9_token_files": op9_token_files,
    "op10_url_filter": op10_url_filter,
    "op11_token_counts": op11_token_counts,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_ranked_search": op13_ranked_search,
    "proximity_matches": proximity_matches,
}


_OP10_SQL = r"""
WITH split AS (
    SELECT page_id, coalesce(html, '') AS html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parsed AS (
    SELECT page_id, html,
           translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM split
), rules(verdict, name, start) AS (
    VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), ruled AS (
    SELECT page_id, host, path, html,
           (SELECT arg_max(struct_pack(rule := name || start, verdict := verdict), length(name || start)) FROM rules
            WHERE (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start)) AS hit
    FROM parsed
), told AS (
    SELECT host, hit,
           regexp_matches(host, '(^|[.-])(ads|bets|casino|gambling|pills|porn|spam|viagra|xxx)([.-]|$)')
               OR regexp_matches(translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                 '(^|[/._-])(ads|bets|casino|gambling|pills|porn|spam|viagra|xxx)([/._-]|$)') AS spelled,
           len(regexp_extract_all(html, '(?i)<a[ \t\r\n]')) AS links,
           regexp_extract_all(translate(regexp_replace(html, '<[^<>]*>?', ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM ruled
), counted AS (
    SELECT *, len(words) AS n,
           len(list_filter(words, lambda x: x IN ('ads', 'bets', 'casino', 'gambling', 'pills', 'porn', 'spam', 'viagra', 'xxx'))) AS unwanted FROM told
), outcomes AS (
    SELECT host, CASE WHEN hit IS NOT NULL THEN hit.verdict = 'block'
                      ELSE spelled OR (unwanted >= 3 AND 50 * unwanted >= n) OR (links >= 20 AND 3 * links >= n) END AS bad
    FROM counted
), hosts AS (
    SELECT host, count(*)::DOUBLE AS n, sum(bad::INT)::DOUBLE AS bad FROM outcomes WHERE host <> '' AND bad IS NOT NULL GROUP BY host
), named AS (
    SELECT *, coalesce(nullif(regexp_extract(host, '([^.]+\.(?:(?:ac|co|com|edu|gov|net|org)\.[a-z][a-z]|[^.]+))$', 1), ''), host) AS domain FROM hosts
), h AS (SELECT *, CASE WHEN strpos(domain, '.') > 0 THEN substr(domain, strpos(domain, '.') + 1) ELSE domain END AS suffix FROM named),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
r AS (SELECT sum(bad) / sum(n) AS rate FROM s),
levels AS (
    SELECT level, count(*) AS k, sum(n) AS pages, sum(n * n) AS squares, sum(n * pow(bad / n - (SELECT rate FROM r), 2)) AS apart,
           sum(bad * (n - bad) / n) AS inside
    FROM (SELECT 's' AS level, n, bad FROM s UNION ALL SELECT 'd', n, bad FROM d UNION ALL SELECT 'h', n, bad FROM h) GROUP BY level
), moments AS (
    SELECT level, k, pages, apart / (k - 1) AS b, inside / nullif(pages - k, 0) AS w, (pages - squares / pages) / (k - 1) AS typical FROM levels
), weights AS (
    SELECT level, CASE WHEN k < 2 OR pages <= k OR b <= w THEN 1000.0
                  ELSE least(1000.0, greatest(1.0, (b + (typical - 1) * w) / (b - w) - 1)) END::DOUBLE AS m
    FROM moments
), sm AS (
    SELECT suffix, (bad + m * rate) / (n + m) AS above FROM s, r, weights WHERE level = 's'
), dm AS (
    SELECT domain, (bad + m * above) / (n + m) AS above FROM d JOIN sm USING (suffix), weights WHERE level = 'd'
), posterior AS (
    SELECT host, bad + m * above AS a, n - bad + m * (1 - above) AS b FROM h JOIN dm USING (domain), weights WHERE level = 'h'
), blocked AS (
    SELECT host FROM posterior WHERE a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5
)
SELECT page_id, host, path, hit.rule AS rule,
       CASE WHEN hit IS NOT NULL THEN hit.verdict WHEN host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

_WORDS_SQL = r"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP3_SQL = f"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS_SQL.format(text="text")}, []) AS w FROM documents
), b AS (
    SELECT item_id, w, least(13, len(w)) AS k FROM (SELECT item_id, {_WORDS_SQL.format(text="text")} AS w FROM benchmark) WHERE len(w) > 0
), windows AS (
    SELECT DISTINCT item_id, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS phrase
    FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS s FROM b)
), grams AS (
    SELECT r, p, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS phrase
    FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)
), found AS (
    SELECT r, p, grams.k AS k, item_id FROM grams JOIN windows ON grams.phrase = windows.phrase AND grams.k = windows.k
), hits AS (
    SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT r, p, k FROM found)) GROUP BY r
), listed AS (
    SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN listed USING (r)
"""

_PROXIMITY_SQL = f"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL.format(text="text")} AS w FROM documents
), placed AS (
    SELECT r, doc_id, unnest(range(len(w))) AS p, unnest(w) AS term FROM d
), items AS (
    SELECT DISTINCT item_id, {_WORDS_SQL.format(text="text")} AS w FROM benchmark
), terms AS (
    SELECT DISTINCT i, item_id, term FROM (SELECT i, item_id, unnest(w) AS term FROM (SELECT *, row_number() OVER () AS i FROM items))
), counts AS (
    SELECT term, count(*) AS n FROM placed WHERE term IN (SELECT term FROM terms) GROUP BY term
), chosen AS (
    SELECT * FROM (SELECT i, item_id, term, row_number() OVER (PARTITION BY i ORDER BY coalesce(n, 0), term) AS rank FROM terms LEFT JOIN counts USING (term))
    WHERE rank <= 3
), found AS (
    SELECT r, doc_id, i, item_id, rank, p FROM placed JOIN chosen USING (term)
), near AS (
    SELECT a.r, a.doc_id, a.i, a.item_id, a.p AS place, b.rank, b.p
    FROM found a JOIN found b ON a.r = b.r AND a.i = b.i AND a.rank = 1 AND b.rank > 1 AND abs(a.p - b.p) < 20
)
SELECT DISTINCT doc_id, item_id, least(place, min(p)) AS begin_word, greatest(place, max(p)) + 1 AS end_word
FROM near GROUP BY r, doc_id, i, item_id, place HAVING count(DISTINCT rank) = 2
"""

_OP2_SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents
), s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS shingle
    FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
    SELECT x.doc_id AS a, y.doc_id AS b
    FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
    GROUP BY a, b HAVING 100 * count(*) >= 85 * (min(nx.n) + min(ny.n) - count(*))
), reach(a, b) AS (
    SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(low.b, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(low.b, d.doc_id)) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON low.a = d.doc_id
"""

_OP12_SQL = r"""
WITH RECURSIVE crc AS (
    -- The table of the reflected polynomial, by its rule.
    SELECT list(c ORDER BY i) AS t
    FROM (SELECT i, list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
                                lambda c, bit: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
          FROM range(256) AS r(i))
), runs AS (
    SELECT id, run, count(*) AS n
    FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(
              translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents)
    WHERE length(run) >= 6 GROUP BY ALL
), hashed AS (
    SELECT run, n, xor(4294967295::UBIGINT, list_reduce(
        list_concat([4294967295::UBIGINT], flatten(list_transform(string_split(id || ':' || run, ''),
            lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::UBIGINT] ELSE [(192 + ord(x) // 64)::UBIGINT, (128 + ord(x) % 64)::UBIGINT] END))),
        lambda c, b: xor(c >> 8, t[(1 + xor(c & 255, b))::BIGINT]))) AS h
    FROM runs, crc
), w AS (
    SELECT word, CAST(sum(n) AS BIGINT) AS n
    FROM (SELECT n, CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM hashed)
    WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), cut AS (
    SELECT word, n, p, left(word, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM w)
), pairs AS (
    SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
    UNION SELECT a.word, w.word, w.n FROM cut a JOIN w ON a.rest = w.word
    UNION SELECT w.word, a.word, a.n FROM cut a JOIN w ON a.rest = w.word
), best AS (
    SELECT word, count(*) AS n_near, max(other_n) AS best_n FROM pairs GROUP BY word
), formed AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * w.n THEN best_n END AS form_n,
           CASE WHEN best_n >= 5 * w.n THEN (SELECT min(other) FROM pairs WHERE pairs.word = w.word AND other_n = best_n) END AS form
    FROM w LEFT JOIN best ON best.word = w.word
), steps AS (
    SELECT word, word AS root, 0 AS k FROM formed
    UNION ALL SELECT steps.word, form, k + 1 FROM steps JOIN formed ON formed.word = root WHERE form IS NOT NULL
)
SELECT word, form, (SELECT arg_max(root, k) FROM steps WHERE steps.word = formed.word) AS root, n, n_near::BIGINT AS n_near, form_n FROM formed
"""

_OP13_SQL = f"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL.format(text="text")} AS w FROM documents
), total AS (
    SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d WHERE len(w) > 0
), q AS (
    SELECT i, item_id, term, count(*) AS times
    FROM (SELECT row_number() OVER () AS i, item_id, unnest({_WORDS_SQL.format(text="text")}) AS term FROM benchmark) GROUP BY ALL
), tf AS (
    SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL
), weight AS (
    SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, docs
), added AS (
    SELECT r, term, weight.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(d.w) * docs) // terms))) AS x
    FROM tf JOIN weight USING (term) JOIN d USING (r), total
), scores AS (
    SELECT i, any_value(item_id) AS item_id, r, CAST(sum(x * times) AS BIGINT) AS score FROM q JOIN added USING (term) GROUP BY i, r
), ranked AS (
    SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS rank, doc_id, score
    FROM scores JOIN d USING (r) WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

ORACLES: dict[str, str] = {
    "op2_near_duplicates": _OP2_SQL,
    "op3_decontamination": _OP3_SQL,
    "op10_url_filter": _OP10_SQL,
    "op12_spelling_variants": _OP12_SQL,
    "op13_ranked_search": _OP13_SQL,
    "proximity_matches": _PROXIMITY_SQL,
}
