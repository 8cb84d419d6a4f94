"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry_jobs.llm import spotsigs, url_filter
from registry_jobs.llm.common import table


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from registry_jobs.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from registry_jobs.llm.toxicity import learn, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))


def op3_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from registry_jobs.llm.pii import find_personal_data, learn

    docs = table(spark, sf_dir, "documents")
    return find_personal_data(docs, learn(docs))


def op4_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op5_media_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from registry_jobs.llm.media import media_digest

    return media_digest(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from registry_jobs.llm.bpe import encode_digest

    return encode_digest(table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from registry_jobs.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from registry_jobs.llm.line_dedup import ENOUGH, dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents"), enough=ENOUGH).select("doc_id", "n_lines", "n_removed", "removed", F.sha2("text", 256).alias("text_sha256"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from registry_jobs.llm.html_text import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from registry_jobs.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from registry_jobs.llm.clustering import cluster_digest

    return cluster_digest(table(spark, sf_dir, "embeddings"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from registry_jobs.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op13_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprint_digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def _url_sql(levels: int = 6) -> str:
    """judge_urls() with its defaults: each level of the tree is a step, and levels beyond these are taken as they are (given paths have two)."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rules = sorted(url_filter.RULES, key=lambda r: (len(r[0]) + len(r[1]), r), reverse=True)
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in rules]
    case = lambda k: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[k]}'" for f in fits) + " END"
    steps = [
        f"""WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{upper}', '{upper.lower()}') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)""",
        f"""b AS (SELECT *, {case(1)} AS rule, {case(2)} AS ruled, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '{url_filter.STAR}') THEN '*' ELSE s END) AS shape FROM u)""",
        """t0 AS (SELECT host, shape, count(*) AS n, count(rule) AS labelled, count(*) FILTER (WHERE ruled = 'block') AS blocked, '' AS template FROM b GROUP BY host, shape)""",
    ]
    for k in range(levels):
        steps += [
            f"""c{k} AS (SELECT host, template, count(DISTINCT shape[{k + 1}]) AS kinds, sum(n) AS pages FROM t{k} WHERE len(shape) > {k} GROUP BY host, template)""",
            f"""t{k + 1} AS (SELECT t.* REPLACE (CASE WHEN len(shape) > {k} THEN template || '/' || CASE WHEN kinds > 8 AND kinds > pages * 0.3 THEN '*' ELSE shape[{k + 1}] END ELSE template END AS template) FROM t{k} t LEFT JOIN c{k} USING (host, template))""",
        ]
    steps += [
        f"""tr AS (SELECT * REPLACE (template || CASE WHEN len(shape) > {levels} THEN '/' || array_to_string(shape[{levels + 1}:], '/') ELSE '' END AS template) FROM t{levels})""",
        r"""lf AS (SELECT host, template, regexp_replace(template, '/[^/]*\z', '') AS parent, sum(labelled) AS labelled, sum(blocked) AS blocked FROM tr GROUP BY host, template)""",
        """sb AS (SELECT host, parent, sum(labelled) AS al, sum(blocked) AS ab FROM lf GROUP BY host, parent)""",
        """k AS (SELECT template, count(*) - 1 AS free, sum(labelled) AS n, sum(blocked) AS b, sum(CAST(blocked * blocked AS DOUBLE) / labelled) AS q, CAST(sum(blocked) AS DOUBLE) / sum(labelled) AS share FROM lf WHERE labelled > 0 GROUP BY template)""",
        """mt AS (SELECT template, (b + 4 * 0.3::DOUBLE) / (n + 4) AS toward FROM k WHERE CASE WHEN share > 0 AND share < 1 THEN (q - b * share) / (share * (1 - share)) ELSE 0 END <= free + 1.96 * sqrt(2.0 * free))""",
        """j0 AS (SELECT lf.*, al, ab, coalesce(toward, 0.3::DOUBLE) AS toward, CAST(ab AS DOUBLE) / nullif(al, 0) AS share FROM lf JOIN sb USING (host, parent) LEFT JOIN mt USING (template))""",
        """j1 AS (SELECT *, labelled > 0 AND abs(CAST(blocked AS DOUBLE) / nullif(labelled, 0) - share) <= 1.96 * sqrt(share * (1 - share) / nullif(labelled, 0)) AS alike FROM j0)""",
        """j2 AS (SELECT host, template, (CASE WHEN alike THEN ab ELSE blocked END + 4 * toward) / (CASE WHEN alike THEN al ELSE labelled END + 4) AS purity FROM j1)""",
    ]
    return ",\n".join(steps) + """
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN purity >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict, template, CASE WHEN rule IS NULL THEN round(purity, 6) END AS purity
FROM b JOIN tr USING (host, shape) JOIN j2 USING (host, template)"""


def _lloyd_sql(clusters: int = 40, rounds: int = 5, dim: int = 64) -> str:
    """Lloyd's rounds in long form: a row a vector and component."""
    steps = [
        f"""WITH kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        """v AS (SELECT row_number() OVER (ORDER BY vec_id, q) AS i, vec_id, q FROM kept)""",
        """x AS (SELECT i, unnest(range(1, len(q) + 1)) AS d, unnest(q) AS x FROM v)""",
        f"""s AS (SELECT row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)), q) - 1 AS k, q FROM v ORDER BY k LIMIT {clusters})""",
        """c0 AS (SELECT k, unnest(range(1, len(q) + 1)) AS d, unnest(q) AS c FROM s)""",
    ]
    for r in range(rounds + 1):
        steps += [
            f"""d{r} AS (SELECT i, k, sum((x - c) * (x - c)) AS far FROM x JOIN c{r} USING (d) GROUP BY i, k)""",
            f"""a{r} AS (SELECT i, k, far FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY far, k) AS nth FROM d{r}) WHERE nth = 1)""",
        ]
        if r < rounds:
            steps += [
                f"""m{r} AS (SELECT k, d, CAST(sum(x) AS BIGINT) AS t, count(*) AS n FROM x JOIN a{r} USING (i) GROUP BY k, d)""",
                f"""c{r + 1} AS (SELECT k, d, CASE WHEN n IS NULL THEN c ELSE (t - ((t % n) + n) % n) // n END AS c FROM c{r} LEFT JOIN m{r} USING (k, d))""",
            ]
    return ",\n".join(steps) + f"""
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(far AS BIGINT) AS distance, CAST(sum(far) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(far) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{rounds} JOIN v USING (i) JOIN (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY d)) AS h FROM c{rounds} GROUP BY k) USING (k)"""


def _collocation_sql(longest: int = 5, least: int = 100, best: int = 2000) -> str:
    """All n-grams of all pieces, counted."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
g AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase
      FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (SELECT unnest(range(1, {longest + 1})) AS m) WHERE len(ws) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY lang, m, phrase HAVING count(*) >= {least}),
n AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws, unnest(range(1, m)) AS k FROM f WHERE m > 1),
s AS (SELECT c.lang, c.m, c.phrase, a, k, x.f AS l, y.f AS r, n.n, (CAST(1000 AS HUGEINT) * a * n.n) // (CAST(x.f AS HUGEINT) * y.f) AS score
      FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[k + 1:], ' ') JOIN n ON n.lang = c.lang),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM s) WHERE nth = 1),
parts AS (SELECT lang, f, string_split(phrase, ' ') AS ws, m, unnest(range(2, m)) AS q FROM f WHERE m > 2),
placed AS (SELECT lang, f, ws, q, unnest(range(1, m - q + 2)) AS i FROM parts),
inner_ AS (SELECT lang, array_to_string(ws[i:i + q - 1], ' ') AS phrase, max(f) AS longer FROM placed GROUP BY 1, 2),
kept AS (SELECT o.* FROM one o LEFT JOIN inner_ USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= {best}"""


def _spotsigs_sql() -> str:
    """Spots in long form: each anchor meets the content words numbered behind it."""
    anchors = ", ".join(f"'{a}'" for a in spotsigs.ANCHORS)
    width = repr(math.log(1 / spotsigs.SIMILARITY) + 1e-9)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT doc_id, text, coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC), max(doc_id) OVER ()) AS next_id FROM d),
e AS (SELECT t.doc_id, t.text, t.next_id, left(t.text, length(t.text) - length(t.text) // 2) || left(d.text, length(t.text) // 2) AS edited FROM t JOIN d ON d.doc_id = t.next_id),
x AS (SELECT doc_id, 0 AS kind, text AS body FROM e UNION ALL SELECT doc_id, 1, edited FROM e),
k AS (SELECT doc_id, kind, regexp_extract_all(translate(body, '{spotsigs.UPPER}', '{spotsigs.LOWER}'), '[\\p{{L}}\\p{{N}}]+') AS ts FROM x),
w AS (SELECT doc_id, kind, unnest(ts) AS w, unnest(range(1, len(ts) + 1)) AS i FROM k),
m AS (SELECT *, w IN ({anchors}) AS anchor FROM w),
n AS (SELECT *, sum(CASE WHEN anchor THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, kind ORDER BY i) AS j FROM m),
c AS (SELECT doc_id, kind, j, w AS w1, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM n WHERE NOT anchor WINDOW o AS (PARTITION BY doc_id, kind ORDER BY i)),
s AS (SELECT n.doc_id, n.kind, list_sort(list_distinct(list(substr(md5(n.w || ' ' || w1 || ' ' || w2 || ' ' || w3), 1, 16)))) AS sigs
      FROM n JOIN c ON c.doc_id = n.doc_id AND c.kind = n.kind AND c.j = n.j + 1 WHERE anchor AND w3 IS NOT NULL GROUP BY n.doc_id, n.kind),
f AS (SELECT k.doc_id, k.kind, coalesce(sigs, ['=' || substr(md5(array_to_string(ts, ' ')), 1, 16)]) AS sigs FROM k LEFT JOIN s USING (doc_id, kind)),
j AS (SELECT e.doc_id, length(e.text) AS n_chars, sha256(edited) AS edited_sha256, a.sigs AS a, b.sigs AS b, len(list_intersect(a.sigs, b.sigs)) AS ab, y.sigs AS y, len(list_intersect(a.sigs, y.sigs)) AS ay
      FROM e JOIN f a ON a.doc_id = e.doc_id AND a.kind = 0 JOIN f b ON b.doc_id = e.doc_id AND b.kind = 1 JOIN f y ON y.doc_id = e.next_id AND y.kind = 0)
SELECT doc_id, n_chars, edited_sha256, array_to_string(a, ' ') AS fingerprint, array_to_string(b, ' ') AS edited_fingerprint,
       CAST(ab AS DOUBLE) / (len(a) + len(b) - ab) AS near_edited, CAST(ay AS DOUBLE) / (len(a) + len(y) - ay) AS near_next,
       CAST(floor(ln(len(a)) / {width}) AS INTEGER) AS length_class, CAST(floor(ln(len(b)) / {width}) AS INTEGER) AS edited_length_class
FROM j"""


def oracle_sql() -> dict[str, str]:
    return {
        "op13_spotsigs": _spotsigs_sql(),
        "op12_phrase_collocations": _collocation_sql(),
        "op11_centroid_clustering": _lloyd_sql(),
        "op4_url_templates": _url_sql(),
        "op10_exact_dedup": """
            WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents)
            SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id,
                   count(*) OVER (PARTITION BY norm) AS group_size,
                   doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
            FROM d""",
    }
