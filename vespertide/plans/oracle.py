"""Common table expressions of the oracle statements: the engine's tables and signals in DuckDB SQL."""

from __future__ import annotations

import re

from vespertide.functions.text import STOP_WORDS
from vespertide.settings import DEFAULTS
from vespertide.sources.tables import EDGES_PER_ITEM, STALE_EVERY

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_W = DEFAULTS.soup_weights

CTES = {
    "c_words": rf"SELECT id, w, min(p) AS p FROM (SELECT id, trim(unnest(l), '''-') AS w, unnest(range(len(l))) AS p FROM (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z''-]{{2,}}') AS l FROM documents)) WHERE length(w) >= 4 AND w NOT IN ({_STOP}) GROUP BY id, w",
    "c_terms": "SELECT id, list(w ORDER BY p) AS overview_terms FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p) AS rn FROM c_words) WHERE rn <= 12 GROUP BY id",
    "c_records": f"""SELECT 2 AS _v, doc_id AS id, trim(substring(text, 1, 30)) AS title, CAST(1950 + doc_id % 70 AS VARCHAR) AS year,
        [lang] AS genres, coalesce(overview_terms, CAST([] AS VARCHAR[])) AS overview_terms, coalesce(overview_terms, CAST([] AS VARCHAR[]))[1:4] AS keywords, 'Person ' || (doc_id % 97) AS director, source AS collection,
        text AS overview, (doc_id % 100) / 10 AS vote_average, CAST(doc_id * 37 % 1000 AS INTEGER) AS vote_count, (doc_id * 13 % 200) / 2 AS popularity, substring(CAST(1950 + doc_id % 70 AS VARCHAR), 1, 3) || '0s' AS decade
        FROM documents LEFT JOIN c_terms ON doc_id = c_terms.id""",
    "c_versions": f"SELECT * REPLACE (CASE WHEN id % {STALE_EVERY} = 0 THEN 1 ELSE 2 END AS _v) FROM c_records",
    "c_items": f"SELECT * FROM c_records WHERE _v = {DEFAULTS.feature_version} AND len(genres) > 0",
    "c_fields": f"""SELECT id, field, wt, v FROM (SELECT id, 'genres' AS field, {_W['genres']} AS wt, unnest(genres) AS v FROM c_items UNION ALL SELECT id, 'director', {_W['director']}, director FROM c_items
        UNION ALL SELECT id, 'keywords', {_W['keywords']}, unnest(keywords) FROM c_items UNION ALL SELECT id, 'overview', {_W['overview']}, unnest(overview_terms) FROM c_items
        UNION ALL SELECT id, 'collection', {_W['collection']}, collection FROM c_items UNION ALL SELECT id, 'decade', {_W['decade']}, decade FROM c_items) WHERE coalesce(v, '') <> ''""",
    "c_informed": f"SELECT id FROM c_fields GROUP BY id HAVING count(DISTINCT replace(lower(v), ' ', '')) >= {DEFAULTS.min_soup_tokens}",
    "c_ftokens": r"SELECT id, field, wt, unnest(regexp_extract_all(replace(lower(v), ' ', ''), '[\p{L}\p{N}_]{2,}')) AS term FROM c_fields WHERE id IN (SELECT id FROM c_informed)",
    "c_tf": "SELECT id, term, sum(wt) AS tf FROM c_ftokens GROUP BY id, term",
    "c_idf": f"SELECT term, count(*) AS df, ln((1 + (SELECT count(DISTINCT id) FROM c_tf)) / (1 + count(*))) + 1 AS idf FROM c_tf GROUP BY term HAVING count(*) >= {DEFAULTS.min_df}",
    "c_raw": "SELECT id, term, (1 + ln(tf)) * idf AS w FROM c_tf JOIN c_idf USING (term)",
    "c_tfidf": "SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM c_raw",
    "c_mids": "SELECT DISTINCT id FROM c_tf",
    "c_allvec": "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings",
    "c_vec": "SELECT id, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS vec, label FROM c_allvec WHERE list_dot_product(vec, vec) > 0 AND id IN (SELECT id FROM c_items)",
    "c_covered": "SELECT id FROM c_mids UNION SELECT id FROM c_vec",
    "c_ratings": "SELECT o_custkey AS \"user\", l_partkey AS item, ceil(l_quantity / 5) / 2 AS rating FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "c_matrix": f"SELECT item, \"user\", sum(1 + (rating - {DEFAULTS.collab_min_rating}) / 1.5) AS v FROM c_ratings WHERE rating >= {DEFAULTS.collab_min_rating} AND item IN (SELECT id FROM c_items) GROUP BY ALL",
    "c_once": "SELECT item, \"user\", v / sqrt(greatest(sum(v) OVER (PARTITION BY \"user\"), 1.0)) AS v FROM c_matrix",
    "c_damped": "SELECT item, \"user\", v / sqrt(greatest(sum(v) OVER (PARTITION BY item), 1.0)) AS v FROM c_once",
    "c_cids": "SELECT item AS id FROM c_matrix GROUP BY item HAVING count(*) >= 5",
    "c_collab": "SELECT item AS id, \"user\" AS term, v / sqrt(sum(v * v) OVER (PARTITION BY item)) AS w FROM c_damped WHERE item IN (SELECT id FROM c_cids)",
    "c_pairs": "SELECT a.p AS src, b.p AS dst, count(*) AS n FROM (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem) b ON a.o = b.o AND a.p <> b.p GROUP BY ALL",
    "c_edges": f"SELECT src, dst, rank FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) - 1 AS rank FROM c_pairs) WHERE rank < {EDGES_PER_ITEM}",
    "c_oneway": "SELECT src, dst, 1 / log2(rank + 2) AS w FROM c_edges WHERE src IN (SELECT id FROM c_items) AND dst IN (SELECT id FROM c_items)",
    "c_adj": "SELECT src, dst, max(w) AS w FROM (SELECT * FROM c_oneway UNION ALL SELECT dst, src, w FROM c_oneway) GROUP BY src, dst UNION ALL SELECT id, id, 1.0 FROM c_items",
    "c_gids": "SELECT src AS id, count(*) AS degree FROM c_adj GROUP BY src HAVING count(*) > 1",
    "c_graph": "SELECT src AS id, dst AS term, w / sqrt(sum(w * w) OVER (PARTITION BY src)) AS w FROM c_adj WHERE src IN (SELECT id FROM c_gids)",
    "c_votes": "SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item, CASE WHEN event_type = 'purchase' THEN 1 ELSE -1 END AS verdict, ts FROM events WHERE event_type IN ('purchase', 'error')",
    "c_current": "SELECT user_id, item, arg_max(verdict, row(ts, event_id)) AS verdict FROM c_votes GROUP BY user_id, item",
    "c_films": "SELECT user_id AS \"user\", row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_type || ' ' || CAST(json_extract_string(props, '$.k') AS VARCHAR) AS title, CAST(2000 + event_id % 20 AS VARCHAR) AS year, CASE WHEN event_type = 'view' THEN NULL ELSE (1 + floor(CAST(json_extract_string(props, '$.k') AS BIGINT) % 10)) / 2 END AS rating FROM events",
}


def statement(select: str, **more: str) -> str:
    """select with the expressions it needs in front; more: expressions of its own, placed before what uses them."""
    every = CTES | more
    order: list[str] = []
    met: set[str] = set()

    def need(text: str) -> None:
        for name in every:
            if name not in met and re.search(rf"\b{name}\b", text):
                met.add(name)
                need(every[name])
                order.append(name)

    need(select)
    parts = [f"{n} AS MATERIALIZED ({every[n]})" for n in order]
    return (f"WITH {', '.join(parts)} " if parts else "") + select


def sims(name: str, weights: str, ids: str, seeds: str) -> dict[str, str]:
    """Similarities of a sparse signal's covered items to the covered ones of some seeds (a query with column seed)."""
    return {
        f"{name}_own": f"SELECT id AS seed, term, w FROM {weights} WHERE id IN (SELECT seed FROM {seeds})",
        f"{name}_met": f"SELECT o.seed AS seed, t.id AS id, sum(t.w * o.w) AS s FROM {weights} t JOIN {name}_own o ON t.term = o.term GROUP BY ALL",
        name: f"SELECT g.seed AS seed, i.id AS id, coalesce(m.s, 0.0) AS s FROM (SELECT DISTINCT seed FROM {name}_own) g CROSS JOIN (SELECT id FROM {ids}) i LEFT JOIN {name}_met m ON m.seed = g.seed AND m.id = i.id",
    }


def dense(name: str, seeds: str) -> dict[str, str]:
    return {name: f"SELECT q.id AS seed, v.id AS id, list_dot_product(v.vec, q.vec) AS s FROM c_vec v CROSS JOIN (SELECT * FROM c_vec WHERE id IN (SELECT seed FROM {seeds})) q"}


def z(name: str, source: str, by: str = "") -> dict[str, str]:
    """Standard deviations above the mean of column s, per group."""
    over = f"OVER (PARTITION BY {by})" if by else "OVER ()"
    return {name: f"SELECT *, (s - m) / d AS z FROM (SELECT *, avg(s) {over} AS m, stddev_pop(s) {over} AS d, count(*) {over} AS n FROM {source}) WHERE n >= 2 AND d > 0"}


def profile(name: str, sim: str, liked: str, rated: str) -> dict[str, str]:
    """Half centroid, half mean of the three best; liked: seed, rating; rated: SQL condition for ratings to count."""
    k, a = DEFAULTS.taste_top_k, DEFAULTS.centroid_weight
    return {
        f"{name}_lw": f"SELECT seed, CASE WHEN {rated} THEN greatest(rating - 2.5, 0.1) ELSE 1.0 END AS lw FROM {liked}",
        f"{name}_top": f"SELECT id, avg(s) AS best FROM (SELECT id, s, row_number() OVER (PARTITION BY id ORDER BY s DESC) AS r FROM {sim}) WHERE r <= {k} GROUP BY id",
        f"{name}_along": f"SELECT id, sum(lw * s) AS along FROM {sim} JOIN {name}_lw USING (seed) GROUP BY id",
        f"{name}_len": f"SELECT sqrt(sum(lw * along)) AS len FROM {name}_along JOIN {name}_lw ON id = seed",
        name: f"SELECT id, {a} * CASE WHEN len > 0 THEN along / len ELSE 0 END + {1 - a} * best AS s FROM {name}_along JOIN {name}_top USING (id) CROSS JOIN {name}_len",
    }


def blended(name: str, parts: list[tuple[float, str]], by: str = "") -> dict[str, str]:
    """Weighted mean of z tables."""
    key = f"{by}, id" if by else "id"
    union = " UNION ALL ".join(f"SELECT {key}, {w} AS w, z FROM {t}" for w, t in parts)
    return {name: f"SELECT {key}, sum(w * z) / sum(w) AS s FROM ({union}) GROUP BY {key}"}
