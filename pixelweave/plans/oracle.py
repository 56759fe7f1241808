"""SQL, as DuckDB runs it, that gives the same rows as the registered queries; built from common table expressions."""

from __future__ import annotations

from pixelweave.functions.genome import Layout, arms, whole_chromosomes
from pixelweave.plans.fixture import BINSIZE, CENTROMERES, LAYOUT, SIZES, pairs_sql

#: Rounds after which the fixture at sf0.01 has converged; the queries stop by their own rule.
IC_ROUNDS = 15


def by_chrom(values: list[int], c: str) -> str:
    return f"(CASE {c} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END)"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)


PAIRS = f"pairs AS ({pairs_sql('//').replace('{lineitem}', 'lineitem')})"
ENDS = f"ends AS (SELECT {by_chrom(LAYOUT.offsets, 'c1')} + (pos1 - 1) // {BINSIZE} AS a, {by_chrom(LAYOUT.offsets, 'c2')} + (pos2 - 1) // {BINSIZE} AS b FROM pairs)"
PX = "px AS MATERIALIZED (SELECT CAST(least(a, b) AS BIGINT) AS bin1_id, CAST(greatest(a, b) AS BIGINT) AS bin2_id, CAST(count(*) AS INTEGER) AS count FROM ends GROUP BY 1, 2)"
PIXELS = f"{PAIRS},\n{ENDS},\n{PX}"


def chroms(layout: Layout = LAYOUT) -> str:
    rows = ", ".join(f"({k}, '{c}', {n}, {layout.offsets[k]}, {layout.counts[k]})" for k, (c, n) in enumerate(layout.sizes))
    return f"chroms(chrom_id, name, length, first, number) AS (VALUES {rows})"


def bins(layout: Layout = LAYOUT) -> str:
    return f"""bins AS (SELECT CAST(first + k AS BIGINT) AS bin_id, CAST(chrom_id AS INTEGER) AS chrom_id, name AS chrom,
        CAST(k * {layout.binsize} AS INTEGER) AS "start", CAST(least((k + 1) * {layout.binsize}, length) AS INTEGER) AS "end"
        FROM chroms, generate_series(0, number - 1) AS g(k))"""


def ends_of(source: str, diags: int = 0, name: str = "touch") -> str:
    where = f" WHERE bin2_id - bin1_id >= {diags}"
    return f"{name} AS (SELECT bin1_id AS bin_id, count FROM {source}{where} UNION ALL SELECT bin2_id, count FROM {source}{where} AND bin1_id <> bin2_id)"


MARG = "marg AS (SELECT bin_id, CAST(sum(count) AS BIGINT) AS marg, CAST(count(*) AS BIGINT) AS nnz FROM touch GROUP BY 1)"


def mask(min_nnz: int = 10, min_count: int = 0, mad_max: float = 5) -> str:
    tests = [f"nnz >= {min_nnz}"] + [f"marg >= {min_count}"] * (min_count > 0) + ["coalesce(s >= cut, TRUE)"] * (mad_max > 0)
    return f"""{chroms()}, {bins()}, {ends_of('px', 2)}, {MARG},
full_ AS (SELECT b.bin_id, chrom_id, coalesce(marg, 0) AS marg, coalesce(nnz, 0) AS nnz FROM bins b LEFT JOIN marg USING (bin_id)),
med AS (SELECT chrom_id, median(marg) AS m FROM full_ WHERE marg > 0 GROUP BY 1),
scaled AS (SELECT full_.*, marg / coalesce(m, 1.0) AS s FROM full_ LEFT JOIN med USING (chrom_id)),
cen AS (SELECT median(ln(s)) AS c FROM scaled WHERE s > 0),
dev AS (SELECT max(c) AS c, median(abs(ln(s) - c)) AS d FROM scaled, cen WHERE s > 0),
mask AS MATERIALIZED (SELECT bin_id, marg, nnz, {' AND '.join(tests)} AS good FROM scaled, (SELECT exp(c - {mad_max} * d) AS cut FROM dev))"""


def corrected(rounds: int) -> str:
    """Unrolled iterative correction: w<rounds> holds the bias before, g<rounds> the last marginal."""
    out = ["far AS MATERIALIZED (SELECT bin1_id AS i, bin2_id AS j, CAST(count AS DOUBLE) AS n FROM px WHERE bin2_id - bin1_id >= 2)", "sym AS MATERIALIZED (SELECT i, j, n FROM far UNION ALL SELECT j, i, n FROM far WHERE i <> j)", "w0 AS MATERIALIZED (SELECT bin_id, CASE WHEN good THEN 1.0::DOUBLE ELSE 0.0 END AS b FROM mask)"]
    for k in range(rounds):
        out.append(f"g{k} AS MATERIALIZED (SELECT x.bin_id, x.b, x.b * coalesce(sum(n * y.b), 0) AS g FROM w{k} x LEFT JOIN sym ON i = x.bin_id LEFT JOIN w{k} y ON y.bin_id = j GROUP BY 1, 2)")
        out.append(f"m{k} AS MATERIALIZED (SELECT avg(g) AS m, stddev_pop(g) / avg(g) AS cv FROM g{k} WHERE g <> 0)")
        out.append(f"w{k + 1} AS MATERIALIZED (SELECT bin_id, CASE WHEN g <> 0 THEN b / (g / m) ELSE b END AS b FROM g{k}, m{k})")
    return ",\n".join(out)


WEIGHTS = f"{PIXELS},\n{mask()},\n{corrected(IC_ROUNDS)},\nwt AS MATERIALIZED (SELECT w.bin_id, CASE WHEN good THEN b / sqrt(m) END AS weight FROM w{IC_ROUNDS} w JOIN mask USING (bin_id), m{IC_ROUNDS - 1})"


def coarse(factor: int, source: str = "px", name: str = "cx", layout: Layout = LAYOUT) -> str:
    to = Layout(layout.sizes, layout.binsize * factor)

    def of(b: str) -> str:
        steps = " ".join(f"WHEN {b} >= {layout.offsets[k]} THEN {to.offsets[k]} + ({b} - {layout.offsets[k]}) // {factor}" for k in reversed(range(len(layout.sizes))))
        return f"(CASE {steps} END)"

    return f"{name} AS MATERIALIZED (SELECT CAST({of('bin1_id')} AS BIGINT) AS bin1_id, CAST({of('bin2_id')} AS BIGINT) AS bin2_id, CAST(least(sum(count), 2147483647) AS INTEGER) AS count FROM {source} GROUP BY 1, 2)"


def block(rows: tuple[int, int], columns: tuple[int, int]) -> str:
    (a0, a1), (b0, b1) = rows, columns
    return f"""blk AS (SELECT bin1_id, bin2_id, count FROM px WHERE bin1_id >= {a0} AND bin1_id < {a1} AND bin2_id >= {b0} AND bin2_id < {b1}
UNION ALL SELECT bin2_id, bin1_id, count FROM px WHERE bin2_id >= {a0} AND bin2_id < {a1} AND bin1_id >= {b0} AND bin1_id < {b1} AND bin1_id <> bin2_id)"""


def regions(kind: str = "arms") -> str:
    found = arms(SIZES, CENTROMERES) if kind == "arms" else whole_chromosomes(SIZES)
    rows = ", ".join(f"({k}, '{r.name}', '{r.chrom}', {r.start}, {r.end}, {LAYOUT.span(r)[0]}, {LAYOUT.span(r)[1]})" for k, r in enumerate(found))
    return f'regions(region_id, name, chrom, "start", "end", first, stop) AS (VALUES {rows})'


MEMBERS = "members AS MATERIALIZED (SELECT region_id, CAST(b AS BIGINT) AS bin_id FROM regions, generate_series(first, stop - 1) AS g(b))"
GOOD = "good AS MATERIALIZED (SELECT region_id, bin_id, weight FROM members JOIN wt USING (bin_id) WHERE weight IS NOT NULL)"
SUMS = "sums AS MATERIALIZED (SELECT a.region_id, bin2_id - bin1_id AS dist, CAST(sum(count) AS DOUBLE) AS count_sum, sum(count * a.weight * b.weight) AS balanced_sum FROM px JOIN good a ON a.bin_id = bin1_id JOIN good b ON b.bin_id = bin2_id AND a.region_id = b.region_id WHERE bin2_id - bin1_id >= 2 GROUP BY 1, 2)"
VALID = "valid AS MATERIALIZED (SELECT a.region_id, b.bin_id - a.bin_id AS dist, count(*) AS n FROM good a JOIN good b ON a.region_id = b.region_id AND b.bin_id >= a.bin_id GROUP BY 1, 2)"
CURVE = "curve AS MATERIALIZED (SELECT region_id, CAST(d AS BIGINT) AS dist, stop - first AS len, coalesce(n, 0) AS n_valid, count_sum, balanced_sum FROM regions, generate_series(0, stop - first - 1) AS g(d) LEFT JOIN valid v USING (region_id, dist) LEFT JOIN sums s USING (region_id, dist))".replace("FROM regions, generate_series(0, stop - first - 1) AS g(d) LEFT JOIN valid v USING (region_id, dist) LEFT JOIN sums s USING (region_id, dist)", "FROM (SELECT *, d AS dist0 FROM regions, generate_series(0, stop - first - 1) AS g(d)) r LEFT JOIN valid v ON v.region_id = r.region_id AND v.dist = dist0 LEFT JOIN sums s ON s.region_id = r.region_id AND s.dist = dist0").replace("SELECT region_id, CAST(d", "SELECT r.region_id, CAST(d")
EXPECTED = f"{WEIGHTS},\n{regions()},\n{MEMBERS},\n{GOOD},\n{SUMS},\n{VALID},\n{CURVE}"


def smoothing(series: str) -> str:
    """series(g, x, s, v): sums and valid pairs by group and separation -> smooth(g, x, value)."""
    return f"""series AS MATERIALIZED ({series}),
sizes AS (SELECT g, max(x) AS top FROM series GROUP BY 1),
grid0(g, x, top) AS (SELECT g, CAST(1 AS BIGINT), top FROM sizes WHERE top >= 1 UNION ALL SELECT g, CAST(floor(x * pow(10, 0.01)) AS BIGINT) + 1, top FROM grid0 WHERE CAST(floor(x * pow(10, 0.01)) AS BIGINT) + 1 <= top),
grid AS MATERIALIZED (SELECT g, x FROM grid0 UNION SELECT g, top FROM sizes WHERE top >= 1),
thin AS MATERIALIZED (SELECT t.g, t.x, sum(s * w) / sum(w) AS s, sum(v * w) / sum(w) AS v FROM (SELECT grid.g, grid.x, series.s, series.v, exp(-pow(log10(grid.x) - log10(series.x), 2) / (2 * 0.1 * 0.1)) AS w FROM grid JOIN series ON series.g = grid.g AND series.x > 0 AND log10(series.x) >= log10(grid.x) - 0.5 AND log10(series.x) < log10(grid.x) + 0.5) t GROUP BY 1, 2),
knots AS MATERIALIZED (SELECT g, x, s, v, lead(x) OVER (PARTITION BY g ORDER BY x) AS x1, lead(s) OVER (PARTITION BY g ORDER BY x) AS s1, lead(v) OVER (PARTITION BY g ORDER BY x) AS v1 FROM thin),
smooth AS MATERIALIZED (SELECT a.g, a.x, CASE WHEN a.x = k.x THEN k.s WHEN k.s > 0 AND k.s1 > 0 THEN exp(ln(k.s) + (ln(a.x) - ln(k.x)) / (ln(k.x1) - ln(k.x)) * (ln(k.s1) - ln(k.s))) END AS s,
  CASE WHEN a.x = k.x THEN k.v WHEN k.v > 0 AND k.v1 > 0 THEN exp(ln(k.v) + (ln(a.x) - ln(k.x)) / (ln(k.x1) - ln(k.x)) * (ln(k.v1) - ln(k.v))) END AS v
  FROM series a JOIN knots k ON k.g = a.g AND k.x <= a.x AND (k.x1 IS NULL OR a.x < k.x1) WHERE a.x > 0)"""
