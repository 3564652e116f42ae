"""Statistics of pairs of samples, their axes, and tests and intervals over pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociweave.operators import analyses as N
from lociweave.operators import axes, bootstrap, changes, diversity, errors, genepairs, haplowindows, linkage, pairs, snps
from lociweave.plans.analysis_queries import _PAIR, _SUBS, _rates
from lociweave.plans.queries import _COPY, _FLIPS, _G, _LD, _copies, _query, rounded
from lociweave.plans.resampling_queries import _H32
from lociweave.sources import adapters as A


@_query(
    """WITH cs AS (SELECT DISTINCT species, contig, pos FROM a_site_grid WHERE depth > 0 AND alt > CEIL(0.05::DOUBLE * depth) + 0.5::DOUBLE AND pos % 3 <> 0),
    r AS (SELECT s.*, c.pos IS NOT NULL AS snp, CASE WHEN c.pos IS NULL THEN NULL WHEN f <= 0.2::DOUBLE THEN 0 WHEN f >= 0.8::DOUBLE THEN 1 END AS g FROM a_sites s LEFT JOIN cs c ON c.species = s.species AND c.contig = s.contig AND c.pos = s.pos),
    k AS (SELECT *, SUM(g) OVER w AS der, COUNT(g) OVER w AS n FROM r WINDOW w AS (PARTITION BY species, contig, pos)),
    u AS (SELECT *, CASE WHEN n >= 4 THEN g END AS h, CASE WHEN g = 1 THEN der ELSE n - der END AS like_me FROM k)
    SELECT a.species, a.sample AS sample_1, b.sample AS sample_2, CAST(SUM(CASE WHEN a.h <> b.h AND a.like_me = 1 THEN 1 ELSE 0 END) AS BIGINT) AS singletons, CAST(SUM(CASE WHEN a.h = b.h AND a.like_me = 2 THEN 1 ELSE 0 END) AS BIGINT) AS doubletons,
      CAST(SUM(CASE WHEN a.h <> b.h THEN 1 ELSE 0 END) AS BIGINT) AS differences, CAST(SUM(CASE WHEN a.snp AND (a.h IS NULL OR b.h IS NULL) THEN 0 ELSE 1 END) AS BIGINT) AS opportunities
    FROM u a JOIN u b ON a.species = b.species AND a.contig = b.contig AND a.pos = b.pos AND a.sample <> b.sample GROUP BY 1, 2, 3"""
)
def pair_singletons(spark, d):
    # called sites, but for those of every third place, so that some covered sites are none
    return changes.pair_singletons(A.annotated(spark, d), snps.called_sites(A.site_counts(spark, d)).filter("pos % 3 <> 0"))


#: Weights of a Poisson bootstrap, by the 16 bits u of a row and a replicate.
_POISSON = " + ".join(f"CAST(u >= {t} AS INTEGER)" for t in bootstrap.POISSON)


def _reps(key: str, seed: int, draws: int) -> str:
    """SQL for the rows ``r`` with replicates and weights."""
    return f"""hs AS (SELECT r.*, c, md5('{seed}|' || {key} || '|' || CAST(c AS VARCHAR)) AS h FROM r, (SELECT UNNEST(range(0, {-(-draws // 8)})) AS c)),
us AS (SELECT hs.*, 8 * c + i AS rep, CAST(('0x' || SUBSTR(h, 4 * i + 1, 4)) AS BIGINT) AS u FROM hs, (SELECT CAST(UNNEST(range(0, 8)) AS INTEGER) AS i)),
ws AS (SELECT *, {_POISSON} AS w FROM us WHERE rep < {draws})"""


_KEY = "species || '|' || sample_1 || '|' || sample_2"
_HALF = f"CAST(SUM(CASE WHEN n_syn > 0 THEN BIT_COUNT({_H32.format(chr(39) + '6|' + chr(39) + ' || ' + _KEY + ' || ' + chr(39) + '|' + chr(39) + ' || CAST(k AS VARCHAR)')} & ((1::BIGINT << LEAST(32, n_syn - 32 * k)) - 1)) ELSE 0 END) AS BIGINT)"
_HALVED = f"""{_SUBS}, ty AS (SELECT {_PAIR}, SUM(CASE WHEN type = '1D' THEN muts + revs ELSE 0 END)::BIGINT AS n_non, SUM(CASE WHEN type = '1D' THEN mo + ro ELSE 0 END)::BIGINT AS l_non, SUM(CASE WHEN type = '4D' THEN muts + revs ELSE 0 END)::BIGINT AS n_syn, SUM(CASE WHEN type = '4D' THEN mo + ro ELSE 0 END)::BIGINT AS l_syn FROM su GROUP BY ALL),
wd AS (SELECT ty.*, UNNEST(range(0, CAST(GREATEST(CEIL(n_syn / 32.0), 1) AS BIGINT))) AS k FROM ty WHERE l_syn > 0 AND l_non > 0),
hf AS (SELECT {_PAIR}, n_syn, n_non, l_syn, l_non, {_HALF} AS half_1 FROM wd GROUP BY ALL),
sel AS (SELECT {_PAIR}, n_syn, n_non, half_1 / (l_syn / 2.0::DOUBLE) AS ds, (n_syn - half_1) / (l_syn / 2.0::DOUBLE) AS ds_other, l_non,
  (1 / (l_syn / 2.0::DOUBLE + l_non) + n_non / l_non::DOUBLE) / (1 / (l_syn / 2.0::DOUBLE + l_non) + (n_syn - half_1) / (l_syn / 2.0::DOUBLE)) AS dnds FROM hf)"""


def _halved(spark, d):
    return bootstrap.halved_selection(_rates(spark, d), seed=6)


@_query(f"WITH {_HALVED} SELECT {_PAIR}, n_syn, n_non, ROUND(ds, 6) AS ds, ROUND(dnds, 5) AS dnds, ROUND(ds_other, 6) AS ds_other, ROUND(ds_other * l_non, 5) AS expected_non FROM sel")
def split_half_selection(spark, d):
    got = _halved(spark, d)
    return got.select(*N.PAIR, "n_syn", "n_non", *[(F.round(c, p) + F.lit(0.0)).alias(c) for c, p in (("ds", 6), ("dnds", 5), ("ds_other", 6), ("expected_non", 5))])


_CUTS = [0.1 * k for k in range(1, 9)]


def _sides(expr: str) -> str:
    return ", ".join(expr.format(s=s, c=c) for s, c in (("below", "<="), ("above", ">")))


@_query(
    f"""WITH {_HALVED}, r AS (SELECT {_PAIR}, ds, n_non::DOUBLE AS num, ds_other * l_non AS den FROM sel WHERE n_syn + n_non > 0), {_reps(_KEY, 8, 500)}, ev AS (SELECT species, -1 AS rep, ds, num, den, 1 AS w FROM r UNION ALL SELECT species, rep, ds, num, den, w FROM ws WHERE w > 0),
    cu AS (SELECT UNNEST([{", ".join(f"{c!r}::DOUBLE" for c in _CUTS)}]) AS cut), su2 AS (SELECT species, rep, cut, SUM(CASE WHEN ds <= cut THEN w ELSE 0 END) AS k, {_sides("SUM(CASE WHEN ds {c} cut THEN w * num END) / NULLIF(SUM(CASE WHEN ds {c} cut THEN w * den END), 0) AS {s}")} FROM ev, cu GROUP BY 1, 2, 3)
    SELECT species, ROUND(cut, 6) AS cut, CAST(MAX(CASE WHEN rep = -1 THEN k END) AS BIGINT) AS n_below, {_sides("ROUND(MAX(CASE WHEN rep = -1 THEN {s} END), 5) AS {s}, ROUND(QUANTILE_CONT(CASE WHEN rep >= 0 THEN {s} END, 0.025), 5) AS {s}_lower, ROUND(QUANTILE_CONT(CASE WHEN rep >= 0 THEN {s} END, 0.975), 5) AS {s}_upper")} FROM su2 GROUP BY 1, 2"""
)
def cumulative_selection_intervals(spark, d):
    rows = _halved(spark, d).filter("n_syn + n_non > 0")
    return rounded(bootstrap.cumulative_intervals(rows, ["species"], list(N.PAIR), "ds", "n_non", "expected_non", _CUTS, seed=8), 5)


@_query(
    f"""WITH pq AS (SELECT a.species, a.sample AS sample_1, b.sample AS sample_2, AVG(a.f * (1 - b.f) + b.f * (1 - a.f)) AS v FROM a_sites a JOIN a_sites b USING (species, contig, pos) WHERE a.sample < b.sample AND a.depth > 1 AND b.depth > 1 AND a.variant_type = '4D' GROUP BY 1, 2, 3),
    mb AS (SELECT DISTINCT species, s.sample, cage = 'C1' AS flag FROM (SELECT species, sample_1 AS sample FROM pq UNION SELECT species, sample_2 FROM pq) s JOIN a_samples USING (sample)),
    nm AS (SELECT *, SUM(CAST(flag AS INTEGER)) OVER (PARTITION BY species) AS n1, COUNT(*) OVER (PARTITION BY species) AS n FROM mb),
    tr AS (SELECT species, sample, t, CASE WHEN t = 0 THEN flag ELSE ROW_NUMBER() OVER (PARTITION BY species, t ORDER BY md5('5|' || species || '|' || sample || '|' || CAST(t AS VARCHAR)), sample) <= n1 END AS f FROM nm, (SELECT UNNEST(range(0, 200)) AS t) WHERE n1 >= 2 AND n - n1 >= 2),
    fs AS (SELECT pq.species, a.t, 1 - AVG(CASE WHEN a.f = b.f THEN v END) / AVG(v) AS fst FROM pq JOIN tr a ON a.species = pq.species AND a.sample = sample_1 JOIN tr b ON b.species = pq.species AND b.sample = sample_2 AND a.t = b.t GROUP BY 1, 2)
    SELECT x.species, ROUND(x.fst, 6) AS fst, (SUM(CASE WHEN y.fst >= x.fst - 1e-9::DOUBLE THEN 1 ELSE 0 END) + 1) / 200.0::DOUBLE AS pvalue FROM fs x JOIN fs y ON x.species = y.species AND x.t = 0 AND y.t > 0 GROUP BY x.species, x.fst"""
)
def permuted_cage_fst(spark, d):
    labels = A.samples(spark, d).select("sample", (F.col("cage") == "C1").alias("flag"))
    return rounded(bootstrap.permuted_fst(diversity.pi_matrix(A.annotated(spark, d)), labels, "pi_between", "flag", seed=5))


@_query()
def principal_coordinates(spark, d):
    return rounded(axes.principal_axes(diversity.genotype_covariance(A.site_counts(spark, d), diagonal=True)))


_CH = ", ".join(f"{c}::DOUBLE" for c in errors.CHANGES)


@_query(
    f"""WITH s AS (SELECT species, sample, depth, alt, COUNT(*) AS n FROM a_site_grid WHERE depth > 0 GROUP BY ALL), al AS (SELECT species, sample, SUM(n) AS n FROM s GROUP BY 1, 2),
    pr AS (SELECT s.species, s.sample, LEAST(CAST(FLOOR(alt::DOUBLE / depth * 20 + 1e-9::DOUBLE) AS INTEGER), 19) AS bin, SUM(s.n) / MAX(al.n)::DOUBLE AS p FROM s JOIN al ON al.species = s.species AND al.sample = s.sample GROUP BY 1, 2, 3),
    de AS (SELECT species, sample, depth, SUM(n) AS n FROM s GROUP BY 1, 2, 3), ch AS (SELECT UNNEST([{_CH}]) AS change),
    ce AS (SELECT depth, bin, (bin + 0.5::DOUBLE) / 20 AS f FROM (SELECT DISTINCT depth FROM de), (SELECT CAST(UNNEST(range(0, 20)) AS INTEGER) AS bin)),
    te AS (SELECT ce.*, k, EXP(LGAMMA(depth + 1.0::DOUBLE) - LGAMMA(k + 1.0::DOUBLE) - LGAMMA(depth - k + 1.0::DOUBLE) + k * LN(f) + (depth - k) * LN(1 - f)) AS p FROM (SELECT ce.*, UNNEST(range(0, CAST(FLOOR(depth * 0.2::DOUBLE + 1e-9::DOUBLE) AS BIGINT) + 1)) AS k FROM ce) ce),
    ta AS (SELECT depth, bin, change, SUM(CASE WHEN k <= depth * ((1 - change) / 2) + 1e-9::DOUBLE THEN p ELSE 0 END) AS tail FROM te, ch GROUP BY 1, 2, 3),
    lo AS (SELECT de.species, de.sample, bin, change, SUM(de.n * tail) / MAX(al.n) AS low FROM de JOIN ta ON ta.depth = de.depth JOIN al ON al.species = de.species AND al.sample = de.sample GROUP BY 1, 2, 3, 4),
    pa AS (SELECT a.sample AS sample_1, b.sample AS sample_2 FROM a_samples a JOIN a_samples b ON a.subject_id = b.subject_id AND b.ord = a.ord + 1),
    mi AS (SELECT species, sample, bin, p FROM pr UNION ALL SELECT species, sample, 19 - bin, p FROM pr),
    we AS (SELECT mi.species, sample_1, sample_2, bin, SUM(p) / 4 AS p FROM pa JOIN mi ON mi.sample = sample_1 OR mi.sample = sample_2 GROUP BY 1, 2, 3, 4)
    SELECT we.species, we.sample_1, we.sample_2, a.change, ROUND(SUM(p * a.low * b.low), 9) AS rate, ROUND(SUM(p * a.low * b.low) * 3e6::DOUBLE, 4) AS expected FROM we JOIN lo a ON a.species = we.species AND a.sample = sample_1 AND a.bin = we.bin
    JOIN lo b ON b.species = we.species AND b.sample = sample_2 AND b.bin = 19 - we.bin AND b.change = a.change GROUP BY 1, 2, 3, 4"""
)
def change_error_rates(spark, d):
    sfs = A.site_grid(spark, d).filter("depth > 0").groupBy("species", "sample", "depth", "alt").agg(F.count(F.lit(1)).alias("n"))
    got = errors.change_errors(sfs, pairs.consecutive(A.samples(spark, d)))
    return got.select(*N.PAIR, "change", F.round("rate", 9).alias("rate"), F.round("expected", 4).alias("expected"))


@_query(
    f"""WITH {_COPY}, rw AS (SELECT species, gene_id, sample, ROUND(reads / cn, 6) AS unit FROM k WHERE cn > 0 AND reads > 0), un AS (SELECT DISTINCT unit FROM rw),
    te AS (SELECT unit, j, EXP(j * LN(unit) - unit - LGAMMA(j + 1.0::DOUBLE)) AS p FROM (SELECT unit, UNNEST(range(0, CAST(FLOOR(unit * 1.2::DOUBLE + 1e-9::DOUBLE) AS BIGINT) + 1)) AS j FROM un)),
    cn AS (SELECT unit, SUM(CASE WHEN j <= unit * 0.05::DOUBLE + 1e-9::DOUBLE THEN p ELSE 0 END) AS gone, SUM(CASE WHEN j >= unit * 0.6::DOUBLE - 1e-9::DOUBLE THEN p ELSE 0 END) AS there FROM te GROUP BY 1),
    ea AS (SELECT rw.*, gone, there FROM rw JOIN cn ON cn.unit = rw.unit), pa AS (SELECT a.sample AS sample_1, b.sample AS sample_2 FROM a_samples a JOIN a_samples b ON a.subject_id = b.subject_id AND b.ord = a.ord + 1)
    SELECT a.species, sample_1, sample_2, COUNT(*) AS n_genes, ROUND(SUM(a.gone * b.there + a.there * b.gone), 5) AS expected FROM pa JOIN ea a ON a.sample = sample_1 JOIN ea b ON b.sample = sample_2 AND b.species = a.species AND b.gene_id = a.gene_id GROUP BY 1, 2, 3"""
)
def gene_change_errors(spark, d):
    return rounded(errors.gene_errors(_copies(spark, d), pairs.consecutive(A.samples(spark, d))), 5)


_CURVE = f"""{_G}, po AS (SELECT species, contig, pos FROM g WHERE g IS NOT NULL GROUP BY 1, 2, 3 HAVING SUM(g) > 0 AND SUM(g) < COUNT(*)),
gg AS (SELECT g.species, g.contig, g.gene_id, g.pos, g.sample, g.g FROM g JOIN po ON po.species = g.species AND po.contig = g.contig AND po.pos = g.pos WHERE g IS NOT NULL),
un AS (SELECT DISTINCT species, contig, gene_id, CAST(SPLIT_PART(gene_id, '.', 4) AS BIGINT) AS number FROM gg),
pl AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY species ORDER BY number, contig) - 1 AS place, COUNT(*) OVER (PARTITION BY species ORDER BY number RANGE BETWEEN UNBOUNDED PRECEDING AND 6 PRECEDING) AS bef,
  COUNT(*) OVER (PARTITION BY species ORDER BY number RANGE BETWEEN UNBOUNDED PRECEDING AND 5 FOLLOWING) AS til, COUNT(*) OVER (PARTITION BY species) AS every FROM un),
dr AS (SELECT *, {_H32.format("'3|' || species || '|' || contig || '|' || gene_id || '|' || CAST(draw AS VARCHAR)")} % (every - (til - bef)) AS r FROM pl, (SELECT UNNEST(range(1, 11)) AS draw) WHERE every - (til - bef) > 0),
pt AS (SELECT species, contig, gene_id, 'within' AS kind, 0 AS step, contig AS oc, gene_id AS other FROM un
  UNION ALL SELECT a.species, a.contig, a.gene_id, 'neighbour', ABS(a.number - b.number), b.contig, b.gene_id FROM un a JOIN un b ON a.species = b.species AND a.contig = b.contig AND ABS(a.number - b.number) BETWEEN 1 AND 5
  UNION ALL SELECT d.species, d.contig, d.gene_id, 'control', 0, p.contig, p.gene_id FROM dr d JOIN pl p ON p.species = d.species AND p.place = CASE WHEN d.r >= d.bef THEN d.r + d.til - d.bef ELSE d.r END),
pn AS (SELECT ROW_NUMBER() OVER () AS id, * FROM pt),
n AS (SELECT pn.id, pn.species, kind, step, a.pos AS p1, b.pos AS p2, SUM(a.g * b.g)::DOUBLE AS n11, SUM(a.g * (1 - b.g))::DOUBLE AS n10, SUM((1 - a.g) * b.g)::DOUBLE AS n01, SUM((1 - a.g) * (1 - b.g))::DOUBLE AS n00, COUNT(*)::DOUBLE AS n
  FROM pn JOIN gg a ON a.species = pn.species AND a.contig = pn.contig AND a.gene_id = pn.gene_id JOIN gg b ON b.species = pn.species AND b.contig = oc AND b.gene_id = other AND b.sample = a.sample WHERE kind <> 'within' OR a.pos < b.pos GROUP BY 1, 2, 3, 4, 5, 6),
q AS (SELECT species, kind, CASE WHEN kind = 'within' THEN CAST(FLOOR((p2 - p1) / 3.0::DOUBLE) AS BIGINT) ELSE step END AS step, n * (n - 1) * (n - 2) * (n - 3) AS w, n11 * (n11 - 1) * n00 * (n00 - 1) - 2 * n11 * n10 * n01 * n00 + n10 * (n10 - 1) * n01 * (n01 - 1) AS num,
  n10 * (n10 - 1) * n01 * (n01 - 1) + n11 * (n11 - 1) * n00 * (n00 - 1) + 2 * n10 * n01 * n11 * n00
  + n10 * n01 * n00 * (n01 - 1 + n10 - 1 + n00 - 1) + n10 * n01 * n11 * (n10 - 1 + n01 - 1 + n11 - 1) + n11 * n00 * n10 * (n10 - 1 + n00 - 1 + n11 - 1) + n11 * n00 * n01 * (n01 - 1 + n11 - 1 + n00 - 1) AS den FROM n WHERE n >= 4)"""


@_query(f"WITH {_CURVE} SELECT species, kind, step, COUNT(*) AS n, ROUND(SUM(num / w), 5) AS num, ROUND(SUM(den / w), 5) AS den, ROUND(SUM(num / w) / SUM(den / w), 5) AS ratio FROM q WHERE den / w > 1e-9::DOUBLE GROUP BY 1, 2, 3")
def linkage_curves(spark, d):
    return rounded(genepairs.linkage_curves(A.annotated(spark, d), seed=3), 5)


_SPAN = f"{errors.SMOOTHING**0.5!r}::DOUBLE"


@_query(
    f"""WITH {_LD}, q AS (SELECT species, CAST(FLOOR((p2 - p1) / 3.0::DOUBLE) AS BIGINT) AS bin, (n11 / n - (n11 + n10) / n * (n11 + n01) / n) ** 2 AS num, (n11 + n10) / n * (1 - (n11 + n10) / n) * (n11 + n01) / n * (1 - (n11 + n01) / n) AS den FROM n WHERE n >= 4),
    b AS (SELECT species, (bin + 0.5::DOUBLE) * 3 AS distance, SUM(num) AS num, SUM(den) AS den FROM q WHERE den > 1e-9::DOUBLE GROUP BY species, bin), st AS (SELECT species, SUM(num) / SUM(den) AS s FROM b WHERE distance <= 9 GROUP BY 1),
    pl AS (SELECT x.species, x.distance, SUM(y.num) / SUM(y.den) AS ratio FROM b x JOIN b y ON x.species = y.species AND y.distance BETWEEN x.distance / {_SPAN} AND x.distance * {_SPAN} GROUP BY 1, 2), r AS (SELECT pl.*, ratio / s AS r FROM pl JOIN st ON st.species = pl.species),
    e AS (SELECT *, CASE WHEN r >= 1 THEN 0 WHEN r > 0 THEN (44 - 260 * r + SQRT((260 * r - 44) ** 2 - 160 * r * (220 * r - 220))) / (80 * r) END AS nr FROM r) SELECT species, distance, ROUND(ratio, 6) AS ratio, ROUND(r, 6) AS relative, ROUND(nr, 5) AS nr, ROUND(nr / distance, 6) AS rate FROM e"""
)
def effective_recombination_rates(spark, d):
    bins = linkage.binned(linkage.sigma_squared(linkage.site_pair_counts(A.annotated(spark, d))))
    got = errors.effective_rates(bins)
    return got.select("species", "distance", F.round("ratio", 6).alias("ratio"), F.round("relative", 6).alias("relative"), (F.round("nr", 5) + F.lit(0.0)).alias("nr"), (F.round("rate", 6) + F.lit(0.0)).alias("rate"))


@_query(
    f"""WITH {_LD}, q AS (SELECT species, CAST(FLOOR((p2 - p1) / 3.0::DOUBLE) AS BIGINT) AS bin, (n11 / n - (n11 + n10) / n * (n11 + n01) / n) ** 2 AS num, (n11 + n10) / n * (1 - (n11 + n10) / n) * (n11 + n01) / n * (1 - (n11 + n01) / n) AS den FROM n WHERE n >= 4),
    b AS (SELECT species, (bin + 0.5::DOUBLE) * 3 AS distance, SUM(num) AS num, SUM(den) AS den FROM q WHERE den > 1e-9::DOUBLE GROUP BY species, bin), st AS (SELECT species, SUM(num) / SUM(den) AS s FROM b WHERE distance <= 9 GROUP BY 1),
    pl AS (SELECT x.species, x.distance, SUM(y.num) / SUM(y.den) AS ratio FROM b x JOIN b y ON x.species = y.species AND y.distance BETWEEN x.distance / {_SPAN} AND x.distance * {_SPAN} GROUP BY 1, 2),
    lo AS (SELECT pl.species, MIN(distance) AS distance FROM pl JOIN st ON st.species = pl.species WHERE ratio / s <= 0.98::DOUBLE GROUP BY 1), pi AS (SELECT species, AVG(2 * f * (1 - f)) AS pi FROM a_sites WHERE variant_type = '4D' AND depth >= 4 GROUP BY 1)
    SELECT lo.species, distance, ROUND((44 - 260 * 0.98::DOUBLE + SQRT((260 * 0.98::DOUBLE - 44) ** 2 - 160 * 0.98::DOUBLE * (220 * 0.98::DOUBLE - 220))) / (80 * 0.98::DOUBLE) / distance / pi * 2, 6) AS r_by_mu FROM lo JOIN pi ON pi.species = lo.species"""
)
def recombination_by_mutation(spark, d):
    sites = A.annotated(spark, d)
    rates = errors.effective_rates(linkage.binned(linkage.sigma_squared(linkage.site_pair_counts(sites))))
    pi = diversity.site_pi(sites, method="regular").filter("variant_type = '4D'").groupBy("species").agg(F.avg("pi").alias("pi"))
    return rounded(errors.recombination_by_mutation(rates, pi, 0.98))


_WIN = f"""{_G}, po AS (SELECT species, contig, pos, ROW_NUMBER() OVER (PARTITION BY species, contig ORDER BY pos) - 1 AS place FROM g WHERE g IS NOT NULL GROUP BY 1, 2, 3 HAVING SUM(g) > 0 AND SUM(g) < COUNT(*)),
wi AS (SELECT *, UNNEST(range(GREATEST(CAST(CEIL((place - 9) / 5.0::DOUBLE) AS BIGINT), 0), CAST(FLOOR(place / 5.0::DOUBLE) AS BIGINT) + 1)) AS win FROM po),
en AS (SELECT species, contig, win, MIN(pos) AS first_pos, MAX(pos) AS last_pos FROM wi GROUP BY 1, 2, 3 HAVING COUNT(*) = 10), sa AS (SELECT DISTINCT species, sample FROM g),
ce AS (SELECT wi.species, wi.contig, wi.win, sa.sample, wi.place, g.g FROM wi JOIN en ON en.species = wi.species AND en.contig = wi.contig AND en.win = wi.win JOIN sa ON sa.species = wi.species LEFT JOIN g ON g.species = wi.species AND g.contig = wi.contig AND g.pos = wi.pos AND g.sample = sa.sample),
hw AS (SELECT species, contig, win, sample, STRING_AGG(COALESCE(CAST(g AS VARCHAR), 'N'), '' ORDER BY place) AS haplotype FROM ce GROUP BY 1, 2, 3, 4 HAVING COUNT(g) > 0),
hc AS (SELECT hw.species, hw.contig, hw.win AS "window", first_pos, last_pos, haplotype, COUNT(*) AS n FROM hw JOIN en ON en.species = hw.species AND en.contig = hw.contig AND en.win = hw.win GROUP BY 1, 2, 3, 4, 5, 6)"""


def _windows(spark, d):
    return haplowindows.window_counts(haplowindows.window_haplotypes(A.site_counts(spark, d).join(A.site_info(spark, d).select("contig", "pos"), ["contig", "pos"]), 10, 5))


@_query(f"WITH {_WIN} SELECT * FROM hc")
def window_haplotype_counts(spark, d):
    return _windows(spark, d)


@_query(
    f"""WITH {_WIN}, q AS (SELECT *, n::DOUBLE / SUM(n) OVER (PARTITION BY species, contig, "window") AS p, ROW_NUMBER() OVER (PARTITION BY species, contig, "window" ORDER BY n DESC, haplotype) AS r FROM hc)
        SELECT species, contig, "window", first_pos, last_pos, COUNT(*) AS k, ROUND(SUM(p * p), 6) AS h1, ROUND(COALESCE(SUM(CASE WHEN r > 1 THEN p * p END), 0), 6) AS h2, ROUND(SUM(CASE WHEN r <= 2 THEN p END) ** 2 + COALESCE(SUM(CASE WHEN r > 2 THEN p * p END), 0), 6) AS h12,
          ROUND(COALESCE(SUM(CASE WHEN r > 1 THEN p * p END), 0) / SUM(p * p), 6) AS h2_h1 FROM q GROUP BY 1, 2, 3, 4, 5"""
)
def window_homozygosity(spark, d):
    return rounded(haplowindows.window_homozygosity(_windows(spark, d)))


@_query()
def clumped_window_homozygosity(spark, d):
    return rounded(haplowindows.window_homozygosity(haplowindows.clumped_windows(_windows(spark, d), 2)))


@_query(
    f"""WITH {_FLIPS}, ch AS (SELECT {_PAIR}, COUNT(*) AS n FROM fl GROUP BY ALL), op AS (SELECT species, a.sample AS sample_1, b.sample AS sample_2, COUNT(*) AS n_sites FROM a_site_counts a JOIN a_site_counts b USING (species, contig, pos) WHERE a.sample < b.sample AND a.depth > 0 AND b.depth >= 20 GROUP BY 1, 2, 3),
    r AS (SELECT op.{_PAIR.replace(", ", ", op.")}, CASE WHEN x.subject_id = y.subject_id THEN 'Within host' ELSE 'Between hosts' END AS host, COALESCE(n, 0)::DOUBLE AS num, n_sites::DOUBLE AS den FROM op LEFT JOIN ch ON ch.species = op.species AND ch.sample_1 = op.sample_1 AND ch.sample_2 = op.sample_2 JOIN a_samples x ON op.sample_1 = x.sample JOIN a_samples y ON op.sample_2 = y.sample),
    {_reps(_KEY, 7, 1000)}, rp AS (SELECT host, rep, SUM(w * num) / NULLIF(SUM(w * den), 0) AS r FROM ws WHERE w > 0 GROUP BY 1, 2)
    SELECT host, ROUND(MAX(s.r), 6) AS rate, ROUND(QUANTILE_CONT(rp.r, 0.025), 6) AS lower_ci, ROUND(QUANTILE_CONT(rp.r, 0.975), 6) AS upper_ci FROM rp JOIN (SELECT host, SUM(num) / SUM(den) AS r FROM r GROUP BY 1) s USING (host) GROUP BY 1"""
)
def rate_intervals(spark, d):
    c, s = A.site_counts(spark, d), A.samples(spark, d)
    n = changes.flips(c).groupBy(*N.PAIR).agg(F.count(F.lit(1)).alias("n"))
    both = changes.opportunities(c).filter("sample_1 < sample_2").join(n, list(N.PAIR), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    got = bootstrap.bootstrap_ratios(both.join(pairs.oriented(pairs.unordered(s), s), ["sample_1", "sample_2"]), ["host"], list(N.PAIR), "n", "n_sites", draws=1000, seed=7)
    return rounded(got.select("host", F.col("ratio").alias("rate"), F.col("lower").alias("lower_ci"), F.col("upper").alias("upper_ci")))


@_query(
    f"""WITH {_SUBS}, r AS (SELECT {_PAIR}, type, CASE WHEN type = '1D' THEN muts + revs ELSE 0 END::DOUBLE AS num, CASE WHEN type = '4D' THEN muts + revs ELSE 0 END::DOUBLE AS den FROM su), {_reps(_KEY + " || '|' || type", 17, 500)},
    rp AS (SELECT species, rep, (SUM(w * num) + 1) / (SUM(w * den) + 1) AS r FROM ws WHERE w > 0 GROUP BY 1, 2)
    SELECT species, ROUND(MAX(s.r), 6) AS ratio, ROUND(QUANTILE_CONT(rp.r, 0.025), 6) AS lower, ROUND(QUANTILE_CONT(rp.r, 0.975), 6) AS upper FROM rp JOIN (SELECT species, (SUM(num) + 1) / (SUM(den) + 1) AS r FROM r GROUP BY 1) s USING (species) GROUP BY 1"""
)
def selection_intervals(spark, d):
    n = F.col("muts") + F.col("revs")
    rows = _rates(spark, d).select(*N.PAIR, "type", F.when(F.col("type") == "1D", n).otherwise(0).alias("a"), F.when(F.col("type") == "4D", n).otherwise(0).alias("b"))
    return rounded(bootstrap.bootstrap_ratios(rows, ["species"], [*N.PAIR, "type"], "a", "b", seed=17, pseudo=1.0))
