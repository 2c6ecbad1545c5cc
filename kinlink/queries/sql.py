"""Shared pieces of the check SQL."""

from kinlink.functions.signatures import MODULUS, hash_family

DOCUMENTS = "SELECT doc_id AS id, text AS name, source AS block FROM documents"
CUSTOMERS = "SELECT c_custkey AS id, c_name AS name, c_nationkey AS block FROM customer"


def typo(name: str, key: str, spread: int) -> str:
    place = f"({key} % {spread})"
    return f"substr({name}, 1, 5 + {place}) || '#' || substr({name}, 7 + {place})"


DOCUMENT_QUERIES = (
    f"SELECT doc_id AS id, {typo('text', 'doc_id', 20)} AS name, source AS block FROM documents"
)
CUSTOMER_QUERIES = (
    f"SELECT c_custkey AS id, {typo('c_name', 'c_custkey', 12)} AS name, "
    "c_nationkey AS block FROM customer"
)

BASE32 = (
    "(list_sum(list_transform(range(1, 65), lambda k: "
    "(instr('0123456789abcdef', substr(hx, k, 1)) - 1) * (1 << (5 * ((64 - k) % 4)))))"
    f"::BIGINT % {MODULUS})"
)


def grams(source: str) -> str:
    """Distinct (id, gram) of the names of a table."""
    return f"""SELECT DISTINCT id, gram FROM (
        SELECT id, unnest(list_transform(range(1, len(ch) - 1),
                   lambda i: ch[i] || ch[i + 1] || ch[i + 2])) AS gram
        FROM (SELECT id, string_split(name, '') AS ch FROM {source} WHERE length(name) >= 3))"""


def numbers(grams_cte: str) -> str:
    """Hash of each distinct gram."""
    return f"""SELECT gram, {BASE32} AS h FROM (
        SELECT gram, sha256(gram) AS hx FROM (SELECT DISTINCT gram FROM {grams_cte}))"""


def signatures(tag: str, source: str, length: int) -> str:
    """CTEs ending in ``{tag}_sig(id, sig)`` for a table ``source(id, name)``."""
    minima = ", ".join(f"min(({a} * h + {b}) % {MODULUS})" for a, b in hash_family(length))
    return f"""{tag}_gram AS ({grams(source)}),
        {tag}_num AS ({numbers(f'{tag}_gram')}),
        {tag}_sig AS (SELECT id, [{minima}] AS sig FROM {tag}_gram JOIN {tag}_num USING (gram)
                      GROUP BY id)"""


def block_links(
    records: str = DOCUMENTS, queries: str = DOCUMENT_QUERIES, minimum: float | None = None
) -> str:
    """CTEs ending in ``pair`` (all scored pairs) and ``link(qid, block, id, score)``."""
    keep = "" if minimum is None else f" AND score >= {minimum}"
    return f"""s AS ({records}), q AS ({queries}),
        {signatures('s', 's', 50)}, {signatures('q', 'q', 50)},
        known AS (SELECT id, block, sig::DOUBLE[] AS v FROM s JOIN s_sig USING (id)),
        asked AS (SELECT id AS qid, block, sig::DOUBLE[] AS v FROM q JOIN q_sig USING (id)),
        pair AS (SELECT qid, asked.block, id,
                   list_dot_product(asked.v, known.v) / sqrt(list_dot_product(asked.v, asked.v)
                     * list_dot_product(known.v, known.v)) AS score
                 FROM asked JOIN known ON asked.block = known.block),
        link AS (SELECT qid, block, id, CASE WHEN score > 1.01 THEN 0 ELSE score END AS score
                 FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rn
                       FROM pair) WHERE rn = 1{keep})"""


LABEL_CENTROIDS = """pt AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings),
    cell AS (SELECT id, label, generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM pt),
    c0 AS (SELECT cluster_id, list(x ORDER BY pos) AS c FROM (
             SELECT label AS cluster_id, pos, avg(x) AS x FROM cell GROUP BY 1, 2)
           GROUP BY cluster_id)"""


def assigned(points: str, centres: str, key: str = "id") -> str:
    """Best centre by rounded dot product, lowest id on ties."""
    return f"""SELECT {key}, cluster_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, cluster_id) AS rn
        FROM (SELECT p.{key}, k.cluster_id, round(list_dot_product(p.v, k.c), 6) AS score
              FROM {points} p, {centres} k)) WHERE rn = 1"""


def lloyd(rounds: int) -> str:
    """CTEs ``a1, c1, ..., c{rounds}`` from ``pt`` and ``c0``; empty clusters keep their centre."""
    parts = []
    for r in range(1, rounds + 1):
        parts.append(
            f"""a{r} AS ({assigned('pt', f'c{r - 1}')}),
            m{r} AS (SELECT cluster_id, list(x ORDER BY pos) AS c FROM (
                SELECT cluster_id, pos, avg(x) AS x FROM a{r} JOIN cell USING (id) GROUP BY 1, 2)
                GROUP BY cluster_id),
            c{r} AS (SELECT o.cluster_id, coalesce(m{r}.c, o.c) AS c
                     FROM c{r - 1} o LEFT JOIN m{r} USING (cluster_id))"""
        )
    return ", ".join(parts)


def scaled(tag: str) -> str:
    """CTEs ``{tag}_pt(id, v)``: z-scores of the unit signatures in ``{tag}_sig``."""
    return f"""{tag}_cell AS (SELECT id, generate_subscripts(v, 1) AS pos,
                 unnest(v) / sqrt(list_dot_product(v, v)) AS x
               FROM (SELECT id, sig::DOUBLE[] AS v FROM {tag}_sig)),
        {tag}_stat AS (SELECT pos, avg(x) AS mean, stddev_pop(x) AS std FROM {tag}_cell GROUP BY pos),
        {tag}_z AS (SELECT id, pos, (x - mean) / CASE WHEN std = 0 THEN 1 ELSE std END AS x
                    FROM {tag}_cell JOIN {tag}_stat USING (pos)),
        {tag}_pt AS (SELECT id, list(x ORDER BY pos) AS v FROM {tag}_z GROUP BY id)"""


def merge(totals: str, min_size: int = 5) -> str:
    """CTEs ``passing``, ``mapping(category, target)`` and ``merged(label, n, total)``."""
    return f"""passing AS (SELECT category, row_number() OVER (
                   ORDER BY substr(md5(category), 1, 2), category) - 1 AS rank
                 FROM {totals} WHERE n > {min_size}),
        mapping AS (
          SELECT category, category AS target FROM passing
          UNION ALL
          SELECT f.category, p.category FROM (
            SELECT category, ('0x' || substr(md5(category), 1, 8))::BIGINT
                     % nullif((SELECT count(*) FROM passing), 0) AS rank
            FROM {totals} WHERE n <= {min_size}) f LEFT JOIN passing p USING (rank)),
        merged AS (SELECT string_agg(category, ' OR ' ORDER BY category) AS label,
                     sum(n)::BIGINT AS n, sum(total) AS total
                   FROM {totals} JOIN mapping USING (category) GROUP BY target)"""


NATION_TOTALS = """t AS (SELECT c_nationkey::VARCHAR || '/' || c_mktsegment AS category,
        count(*) AS n, sum(c_acctbal::DECIMAL(18,2)) AS total FROM customer GROUP BY 1)"""


MATCHED_TOTALS = """t AS (SELECT source || '/' || lang AS category, count(*) AS n,
        sum(n_chars)::BIGINT AS total FROM documents
        WHERE doc_id IN (SELECT id FROM link) GROUP BY 1)"""
