"""DuckDB SQL for the queries of the catalogue, put together from parts."""

from __future__ import annotations

BASE = "base AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings), q AS (SELECT id AS qid, v AS qv FROM base WHERE id % 100 = 0)"


def ip_raw(a: str, b: str) -> str:
    return f"(1 - list_dot_product({a}, {b}))"


def l2_raw(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"


def dot_sum(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda x: x[1] * x[2]))"


def rounded(x: str) -> str:
    return f"round({x}, 6)"


def ip(a: str = "qv", b: str = "v") -> str:
    return rounded(ip_raw(a, b))


def l2(a: str = "qv", b: str = "v") -> str:
    return rounded(l2_raw(a, b))


def unit(v: str) -> str:
    return f"list_transform({v}, lambda y: y / (sqrt(list_dot_product({v}, {v})) + 1e-30))"


def topk(source: str, k: int, by: str = "qid", columns: str = "qid, rank, id, dist") -> str:
    """Rows of ``source`` by (dist, id) within ``by``, up to k."""
    return f"SELECT {columns} FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {by} ORDER BY dist, id) AS INTEGER) AS rank FROM ({source})) WHERE rank <= {k}"


def flat(k: int, dist: str | None = None, where: str = "true") -> str:
    return topk(f"SELECT qid, id, {dist or ip()} AS dist FROM q, base WHERE {where}", k)


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join([BASE, *ctes]) + " "


def sample(size: int, parts: int = 1, width: int = 64, source: str = "base", s: str = "s") -> str:
    """{s}(m, t, v): the training rows ``t * n // size``, cut into parts; {s}n holds n and size."""
    return (
        f"{s}n AS (SELECT count(*) AS n, least({size}, count(*)) AS tn FROM {source}), "
        f"{s} AS (SELECT m, t, v[m * {width} + 1 : (m + 1) * {width}] AS v FROM range({size}) r(t), range({parts}) p(m), {s}n JOIN {source} b ON b.id = (t * n) // tn WHERE t < tn)"
    )


def lloyd(count: int, iters: int, width: int = 64, how: str = "uniform", empty: str = "reseed", name: str = "c", s: str = "s") -> str:
    """{name}{iters}(m, c, cv): unrolled rounds over {s}; means are of values fixed to nine decimals."""
    start = f"(r.c * tn) // {count}" if how == "uniform" else "r.c % tn"
    out = [f"{name}0 AS (SELECT x.m, r.c, x.v AS cv FROM range({count}) r(c), {s}n JOIN {s} x ON x.t = {start})"]
    for i in range(1, iters + 1):
        prev = f"{name}{i - 1}"
        refill = f"(SELECT x.v FROM {s} x, {s}n WHERE x.m = p.m AND x.t = (p.c + {i}) % tn)" if empty == "reseed" else "p.cv"
        out.append(
            f"{name}a{i} AS (SELECT m, t, v, c FROM (SELECT x.m, x.t, x.v, k.c, row_number() OVER (PARTITION BY x.m, x.t ORDER BY {l2_raw('x.v', 'k.cv')}, k.c) AS rn FROM {s} x JOIN {prev} k ON k.m = x.m) WHERE rn = 1)"
        )
        out.append(
            f"{name}m{i} AS (SELECT m, c, list(x ORDER BY i) AS cv FROM (SELECT m, c, i, sum(CAST(floor(x * 1e9 + 0.5) AS BIGINT)) / count(*) / 1e9 AS x FROM (SELECT m, c, unnest(v) AS x, unnest(range({width})) AS i FROM {name}a{i}) GROUP BY m, c, i) GROUP BY m, c)"
        )
        out.append(f"{name}{i} AS (SELECT p.m, p.c, coalesce(k.cv, {refill}) AS cv FROM {prev} p LEFT JOIN {name}m{i} k ON k.m = p.m AND k.c = p.c)")
    return ", ".join(out)


def assigned(centroids: str, name: str = "listed") -> str:
    return f"{name} AS (SELECT id, v, list_id FROM (SELECT b.id, b.v, CAST(k.c AS INTEGER) AS list_id, row_number() OVER (PARTITION BY b.id ORDER BY {l2_raw('b.v', 'k.cv')}, k.c) AS rn FROM base b, {centroids} k) WHERE rn = 1)"


def probes(centroids: str, count: int, dist: str | None = None) -> str:
    d = dist or l2("q.qv", "k.cv")
    return f"probes AS (SELECT qid, rank, list_id, dist FROM (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, list_id) AS INTEGER) AS rank, list_id, dist FROM (SELECT q.qid, CAST(k.c AS INTEGER) AS list_id, {d} AS dist FROM q, {centroids} k)) WHERE rank <= {count})"


def pq_codes(books: str, parts: int, width: int) -> str:
    return (
        f"codes AS (SELECT id, m, c FROM (SELECT b.id, k.m, k.c, row_number() OVER (PARTITION BY b.id, k.m ORDER BY {l2_raw(f'b.v[k.m * {width} + 1 : (k.m + 1) * {width}]', 'k.cv')}, k.c) AS rn FROM base b, {books} k) WHERE rn = 1)"
    )


def pq_lut(books: str, width: int) -> str:
    return f"lut AS (SELECT q.qid, k.m, k.c, list_dot_product(q.qv[k.m * {width} + 1 : (k.m + 1) * {width}], k.cv) AS x FROM q, {books} k)"


LUT16 = "lut16 AS (SELECT l.qid, l.m, l.c, CAST(sign(x * scale) * floor(abs(x * scale) + 0.5) AS BIGINT) AS x FROM lut l JOIN (SELECT qid, CASE WHEN max(abs(x)) > 0 THEN 32767 / max(abs(x)) ELSE 1.0 END AS scale FROM lut GROUP BY qid) USING (qid))"


def reranked(candidates: str, k: int, by: str = "qid", columns: str = "qid, rank, id, dist") -> str:
    return topk(f"SELECT x.*, {ip('q.qv', 'b.v')} AS dist FROM (SELECT * EXCLUDE (dist, rank) FROM {candidates}) x JOIN base b USING (id) JOIN q USING (qid)", k, by, columns)


def documents(doc: str, count: int, dist: str) -> str:
    """The nearest rows of each query, as long as they are of ``count`` documents."""
    ranked = f"SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS INTEGER) AS rank, id, doc_id, dist, row_number() OVER (PARTITION BY qid, doc_id ORDER BY dist, id) AS fresh FROM (SELECT qid, id, {doc} AS doc_id, {dist} AS dist FROM q, base)"
    return with_() + f"SELECT qid, rank, id, doc_id, dist FROM (SELECT *, sum(CASE WHEN fresh = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY dist, id ROWS UNBOUNDED PRECEDING) AS docs FROM ({ranked})) WHERE docs <= {count}"
