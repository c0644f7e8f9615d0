"""Queries for tests, drift and embeddings, each with the SQL of the same rows where SQL has it."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.columns import cosine, rounded
from corpusmill.operators import statistics as st
from corpusmill.operators import vectors as ve
from corpusmill.sources.views import evaluation, table, tracks

from .evaluation import r

KEYS = ["prompt", "bpm_target", "seed_no"]


def paired(s, d, *others):
    rows = evaluation(s, d)
    return st.pairs(rows.where("checkpoint = 'ck0'"), rows.where("checkpoint = 'ck1'"), ["prompt", "bpm_target"], ["clap_score", "deviation"], "event_id", list(others))


def by_checkpoints(s, d):
    """Mean clap of each intent under two checkpoints."""
    by = evaluation(s, d).where("clap_score is not null").groupBy("intent").agg(
        F.avg(F.when(F.col("checkpoint") == "ck0", F.col("clap_score"))).alias("a"), F.avg(F.when(F.col("checkpoint") == "ck1", F.col("clap_score"))).alias("b")
    )
    return by.select("intent", "a", "b", (F.col("b") - F.col("a")).alias("d")).where("d is not null")


def vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")


def dedup(s, d):
    edges = ve.pairs_above(vectors(s, d), "vec_id", "embedding", 0.4)
    return ve.greedy_clusters(edges)


def shifted(s, d):
    v = vectors(s, d).select("vec_id", F.slice(F.transform("embedding", lambda x: x.cast("double")), 1, 12).alias("v"))
    one = v.where("vec_id = 0").select(F.col("v").alias("w"))
    return v.join(F.broadcast(one)).select("vec_id", rounded(ve.shift_similarity(F.col("v"), F.col("w"))).alias("similarity"))


_PAIRS = """o as (select prompt, bpm_target, clap_score, deviation from ev where checkpoint = 'ck0'),
n as (select * from (select prompt, bpm_target, clap_score, deviation, row_number() over (partition by prompt, bpm_target order by event_id desc) as i from ev where checkpoint = 'ck1') where i = 1),
p as (select o.prompt, o.bpm_target, o.clap_score as clap_score_a, o.deviation as deviation_a, n.clap_score as clap_score_b, n.deviation as deviation_b
      from o join n on o.prompt = n.prompt and o.bpm_target = n.bpm_target)"""
_DIFFS = """g as (select intent, avg(clap_score) filter (checkpoint = 'ck0') as a, avg(clap_score) filter (checkpoint = 'ck1') as b from ev where clap_score is not null group by intent),
x as (select intent, a, b, b - a as d from g where b - a is not null)"""
_COS = "list_dot_product({a}::double[], {b}::double[]) / (sqrt(list_dot_product({a}::double[], {a}::double[])) * sqrt(list_dot_product({b}::double[], {b}::double[])))"
#: The share of a normal distribution below z, by a series of positive terms.
_BELOW = "(0.5e0 + sign({z}) * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * case when abs({z}) < 1e-9 then abs({z}) else list_sum(list_transform(range(0, 400), lambda i: exp((2 * i + 1) * ln(greatest(abs({z}), 1e-9)) - ((i + 1) * ln(2e0) + lgamma(i + 1.5e0) - 0.5e0 * ln(pi()))))) end)"
_RANKS = """, k as (select d, rank() over (order by abs(d)) + (count(*) over (partition by abs(d)) - 1) / 2e0 as rk, count(*) over (partition by abs(d)) as t from x where abs(d) > 1e-12)"""
_PSI = "round(sum((c - q) * ln(c / q)), 6) + 0e0"

QUERIES = {
    "paired_results": (lambda s, d: paired(s, d), _PAIRS + " select * from p"),
    "paired_win_rate": (
        lambda s, d: st.win_rate(paired(s, d), "clap_score_a", "clap_score_b"),
        _PAIRS + f""", w as (select count(*) filter (clap_score_b - clap_score_a > 1e-9) as wins, count(*) filter (abs(clap_score_b - clap_score_a) <= 1e-9) as ties,
        count(*) filter (clap_score_b - clap_score_a < -1e-9) as losses from p where clap_score_a is not null and clap_score_b is not null)
        select *, {r('wins / nullif(wins + losses, 0)')} as win_rate from w""",
    ),
    "signed_rank_sums": (
        lambda s, d: st.signed_ranks(by_checkpoints(s, d)).select("n", rounded("w_plus", 2).alias("w_plus"), rounded("w_minus", 2).alias("w_minus")),
        _DIFFS + """, k as (select d, rank() over (order by abs(d)) + (count(*) over (partition by abs(d)) - 1) / 2e0 as rk from x where abs(d) > 1e-12)
        select count(*) as n, round(coalesce(sum(case when d > 0 then rk end), 0), 2) + 0e0 as w_plus, round(coalesce(sum(case when d < 0 then rk end), 0), 2) + 0e0 as w_minus from k""",
    ),
    "wilcoxon_test": (
        lambda s, d: st.wilcoxon(by_checkpoints(s, d)).select("n", rounded("w_plus", 2).alias("w_plus"), rounded("p", 6).alias("p")),
        _DIFFS + _RANKS + f""", o as (select count(*) as n, coalesce(sum(case when d > 0 then rk end), 0) as w, coalesce(sum(t * t - 1), 0) as ties from k),
        c as (select ways from (with recursive e as (select 0 as j, list_transform(range(0, cast(n * (n + 1) / 2 as int) + 1), lambda i: case when i = 0 then 1e0 else 0e0 end) as ways from o
            union all select j + 1, list_transform(range(0, len(ways)), lambda i: ways[i + 1] + case when i >= j + 1 then ways[i - j] else 0e0 end) from e, o where j < least(n, 50)) select * from e) order by j desc limit 1),
        z as (select *, abs(w - n * (n + 1) / 4e0) / nullif(sqrt(n * (n + 1) * (2 * n + 1) / 24e0 - ties / 48e0), 0) as z from o)
        select n, round(w, 2) + 0e0 as w_plus, case when n = 0 then 1e0 when n < 5 then null when n <= 50 and ties = 0 then {r('least(1e0, 2 * list_sum(ways[1:cast(least(w, n * (n + 1) / 2 - w) as int) + 1]) / pow(2e0, n))', 6)}
            when z is null then 1e0 else {r('2 * (1 - ' + _BELOW.format(z='z') + ')', 6)} end as p from z, c""",
    ),
    "bayesian_comparison": (
        lambda s, d: st.bayesian_ab(by_checkpoints(s, d)),
        _DIFFS + f""", o as (select count(d) as n, avg(d) as m, var_samp(d) as v from x), q as (select *, case when n > 1 then n / greatest(v, 1e-12) end as w from o),
        p as (select n, w * m / (w + 1e-3) as mean, sqrt(1 / (w + 1e-3)) as sd from q), z as (select *, mean / sd as z from p)
        select n, round(mean, 4) + 0e0 as posterior_mean, round(sd, 6) + 0e0 as posterior_sd, {r(_BELOW.format(z='z'))} as p_better from z""",
    ),
    "bayesian_posterior": (
        lambda s, d: st.bayesian_ab(by_checkpoints(s, d)).select("n", "posterior_mean", "posterior_sd"),
        _DIFFS + """, o as (select count(d) as n, avg(d) as m, var_samp(d) as v from x), q as (select *, case when n > 1 then n / greatest(v, 1e-12) end as w from o)
        select n, round(w * m / (w + 1e-3), 4) + 0e0 as posterior_mean, round(sqrt(1 / (w + 1e-3)), 6) + 0e0 as posterior_sd from q""",
    ),
    "meta_analysis": (
        lambda s, d: st.meta_analysis(evaluation(s, d).where("clap_score is not null").groupBy("section").agg(F.avg(F.col("clap_score") - 0.5).alias("delta"), (F.stddev_samp("clap_score") / F.sqrt(F.count("*"))).alias("se"))),
        """t as (select avg(clap_score - 0.5) as delta, stddev_samp(clap_score) / sqrt(count(*)) as se from ev where clap_score is not null group by section)
        select count(*) as k, round(sum(delta / se) / sum(1 / se), 6) + 0e0 as pooled_delta, round(sqrt(1 / sum(1 / se)), 6) + 0e0 as pooled_se,
        round((sum(delta / se) / sum(1 / se)) / sqrt(1 / sum(1 / se)), 4) + 0e0 as z from t where se > 0""",
    ),
    "multiple_comparison": (
        lambda s, d: st.multiple_comparison(evaluation(s, d).groupBy(F.col("prompt").alias("name")).agg(rounded(F.count_if(F.col("status") == "ok") / F.count("*") / 10, 6).alias("p"))),
        """t as (select prompt as name, round(count(*) filter (status = 'ok') / count(*) / 10, 6) + 0e0 as p from ev group by prompt),
        k as (select *, count(*) over () as m, row_number() over (order by p, name) as rank from t), l as (select *, max(case when p <= rank / m * 0.05e0 then rank end) over () as last from k)
        select name, p, rank, p <= 0.05e0 / m as bonferroni, p <= rank / m * 0.05e0 as per_rank, rank <= coalesce(last, 0) as step_up from l""",
    ),
    "psi_tempo": (
        lambda s, d: st.psi(tracks(s, d), "bpm", F.col("split") == "train"),
        f"""q0 as (select list_transform(range(1, 10), lambda i: i / 10e0) as ps), e as (select quantile_cont(bpm, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as edges from tracks where split <> 'train' and bpm is not null),
        b as (select len(list_filter(edges, lambda x: x <= bpm)) as bin, count(*) filter (split = 'train') as cc, count(*) filter (split <> 'train') as rr from tracks, e where bpm is not null group by 1),
        z as (select sum(rr) over () as tr, sum(cc) over () as tc, greatest(cc / sum(cc) over (), 1e-6) as c, greatest(rr / sum(rr) over (), 1e-6) as q from b)
        select cast(max(tr) as bigint) as n_reference, cast(max(tc) as bigint) as n_current, {_PSI} as psi from z""",
    ),
    "psi_genre": (
        lambda s, d: st.category_psi(tracks(s, d), "genre", F.col("split") == "train"),
        f"""b as (select genre, count(*) filter (split = 'train') as cc, count(*) filter (split <> 'train') as rr from tracks group by genre),
        z as (select sum(rr) over () as tr, sum(cc) over () as tc, greatest(cc / sum(cc) over (), 1e-6) as c, greatest(rr / sum(rr) over (), 1e-6) as q from b)
        select cast(max(tr) as bigint) as n_reference, cast(max(tc) as bigint) as n_current, {_PSI} as psi from z""",
    ),
    "ks_distance": (
        lambda s, d: st.ks(evaluation(s, d), "value", F.col("checkpoint") == "ck0"),
        """c as (select value as v, count(*) filter (checkpoint = 'ck0') as c, count(*) filter (checkpoint <> 'ck0') as q from ev group by value),
        f as (select sum(c) over (order by v) / sum(c) over () as fc, sum(q) over (order by v) / sum(q) over () as fr from c)
        select (select count(*) from ev where checkpoint = 'ck0') as n, (select count(*) from ev where checkpoint <> 'ck0') as m, round(max(abs(fc - fr)), 6) + 0e0 as distance from f""",
    ),
    "ks_test": (
        lambda s, d: st.ks(evaluation(s, d), "value", F.col("checkpoint") == "ck0").withColumn("p", rounded(st.ks_p("distance", "n", "m"), 6)),
        """c as (select value as v, count(*) filter (checkpoint = 'ck0') as c, count(*) filter (checkpoint <> 'ck0') as q from ev group by value),
        f as (select sum(c) over (order by v) / sum(c) over () as fc, sum(q) over (order by v) / sum(q) over () as fr from c),
        k as (select (select count(*) from ev where checkpoint = 'ck0') as n, (select count(*) from ev where checkpoint <> 'ck0') as m, round(max(abs(fc - fr)), 6) + 0e0 as distance from f), x as (select *, distance * sqrt(n * m / (n + m)) as x from k)
        select n, m, distance, round(case when x < 0.2 then 1e0 else greatest(0e0, least(1e0, 2 * list_sum(list_transform(range(1, 101), lambda i: case when i % 2 = 1 then 1e0 else -1e0 end * exp(-2e0 * i * i * x * x))))) end, 6) + 0e0 as p from x""",
    ),
    "bootstrap_intervals": (lambda s, d: st.bootstrap(evaluation(s, d), "checkpoint", "event_id", "clap_score"), None),
    "difference_interval": (lambda s, d: st.difference_interval(paired(s, d, "event_id"), "event_id", "clap_score_a", "clap_score_b"), None),
    "score_intervals": (lambda s, d: st.score_interval(evaluation(s, d), "checkpoint", "event_id"), None),
    "checkpoint_scores": (
        lambda s, d: st.score_interval(evaluation(s, d), "checkpoint", "event_id", draws=2).select("checkpoint", "n", "score"),
        """select checkpoint, count(*) as n, round(0.4e0 * avg(case when status = 'ok' then 1e0 else 0e0 end) + 0.3e0 * coalesce(avg(clap_score), 0) + 0.3e0 * greatest(0e0, 1e0 - coalesce(avg(abs(deviation)), 0) / 0.2e0), 4) + 0e0 as score from ev group by checkpoint""",
    ),
    "sign_test": (
        lambda s, d: st.win_rate(paired(s, d), "clap_score_a", "clap_score_b").withColumn("p", rounded(st.sign_p("wins", "losses"), 6)),
        _PAIRS + f""", w as (select count(*) filter (clap_score_b - clap_score_a > 1e-9) as wins, count(*) filter (abs(clap_score_b - clap_score_a) <= 1e-9) as ties,
        count(*) filter (clap_score_b - clap_score_a < -1e-9) as losses from p where clap_score_a is not null and clap_score_b is not null),
        nn as (select *, wins + losses as n, abs(wins - (wins + losses) / 2e0) as far from w), z as (select *, greatest(0, far - 0.5e0) / nullif(sqrt(n) / 2, 0) as z from nn)
        select wins, ties, losses, {r('wins / nullif(wins + losses, 0)')} as win_rate, case when n = 0 then 1e0 when n > 1000 then {r('least(1e0, 2 * (1 - ' + _BELOW.format(z='z') + '))', 6)}
            else {r('least(1e0, list_sum(list_transform(range(0, n + 1), lambda k: case when abs(k - n / 2e0) >= far then exp(lgamma(n + 1e0) - lgamma(k + 1e0) - lgamma(n - k + 1e0) - n * ln(2e0)) else 0e0 end)))', 6)} end as p from z""",
    ),
    "cosine_to_first": (
        lambda s, d: vectors(s, d).join(F.broadcast(vectors(s, d).where("vec_id = 0").select(F.col("embedding").alias("first"))), how="cross").select("vec_id", rounded(cosine("embedding", "first")).alias("cosine")),
        f"select e.vec_id, {r(_COS.format(a='e.embedding', b='f.embedding'))} as cosine from embeddings e, embeddings f where f.vec_id = 0",
    ),
    "nearest_tracks": (
        lambda s, d: ve.nearest(vectors(s, d).where("vec_id % 100 = 0"), vectors(s, d), "vec_id", "embedding", 5).select("query", "rank", "id"),
        f"""p as (select q.vec_id as query, e.vec_id as id, round({_COS.format(a='q.embedding', b='e.embedding')}, 6) as sim from embeddings q join embeddings e on q.vec_id <> e.vec_id where q.vec_id % 100 = 0),
        k as (select *, row_number() over (partition by query order by sim desc, id) as rank from p) select query, rank, id from k where rank <= 5""",
    ),
    "similar_pairs": (
        lambda s, d: ve.pairs_above(vectors(s, d), "vec_id", "embedding", 0.35).select("a", "b"),
        f"select x.vec_id as a, y.vec_id as b from embeddings x join embeddings y on x.vec_id < y.vec_id where round({_COS.format(a='x.embedding', b='y.embedding')}, 6) >= 0.35",
    ),
    "cross_split_pairs": (
        lambda s, d: ve.pairs_above(vectors(s, d).withColumn("split", F.col("vec_id") % 3), "vec_id", "embedding", 0.35, "split").select("a", "b"),
        f"select x.vec_id as a, y.vec_id as b from embeddings x join embeddings y on x.vec_id < y.vec_id and x.vec_id % 3 <> y.vec_id % 3 where round({_COS.format(a='x.embedding', b='y.embedding')}, 6) >= 0.35",
    ),
    "greedy_dedup": (
        dedup,
        f"""e as (select x.vec_id as a, y.vec_id as b from embeddings x join embeddings y on x.vec_id < y.vec_id where round({_COS.format(a='x.embedding', b='y.embedding')}, 6) >= 0.4),
        n as (select id, row_number() over (order by id) as k from (select a as id from e union select b from e)), s as (select k, id, list(a) filter (a is not null) as small from n left join e on b = id group by k, id)
        select * from (with recursive g as (select cast(0 as bigint) as k, cast([] as bigint[]) as reps union all
            select s.k, case when list_has_any(coalesce(small, []), reps) then reps else list_append(reps, cast(id as bigint)) end from g join s on s.k = g.k + 1),
        c as (select unnest(reps) as rep from g where k = (select max(k) from g))
        select min(a) as representative, b as member from e join c on a = rep where b not in (select rep from c) group by b)""",
    ),
    "embedding_centroid": (
        lambda s, d: ve.centroid(vectors(s, d), "embedding").select("i", rounded("c").alias("c")),
        f"""u as (select vec_id, unnest(range(64)) as i, unnest(embedding::double[]) as x, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from embeddings),
        m as (select i, avg(x / n) as m from u group by i) select cast(i as int) as i, {r('m / (select sqrt(sum(m * m)) from m)')} as c from m""",
    ),
    "embedding_novelty": (
        lambda s, d: ve.novelty(vectors(s, d), "vec_id", "embedding"),
        f"""u as (select vec_id, unnest(range(64)) as i, unnest(embedding::double[]) as x, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from embeddings),
        m as (select i, avg(x / n) as m from u group by i), c as (select i, m / (select sqrt(sum(m * m)) from m) as c from m)
        select vec_id, {r('greatest(0e0, least(1e0, 1e0 - sum(x * c) / max(n)))')} as novelty from u join c using (i) group by vec_id""",
    ),
    "two_sample_distances": (lambda s, d: ve.two_sample(vectors(s, d).where("label < 5"), vectors(s, d).where("label >= 5"), "embedding"), None),
    "embedding_leakage": (
        lambda s, d: ve.leakage(vectors(s, d).where("label < 5"), vectors(s, d).where("label >= 5"), "vec_id", "embedding", 0.35),
        f"""p as (select g.vec_id, max(round({_COS.format(a='g.embedding', b='f.embedding')}, 6)) as sim from embeddings g, embeddings f where g.label >= 5 and f.label < 5 group by g.vec_id)
        select count(*) as n_gen, count(*) filter (sim >= 0.35) as n_leaks, {r('avg(sim)')} as mean_nn_sim, {r('max(sim)')} as max_nn_sim from p""",
    ),
    "propagated_labels": (
        lambda s, d: ve.propagated(vectors(s, d).where("vec_id % 5 = 0"), vectors(s, d).where("vec_id % 5 <> 0"), "vec_id", "embedding", "label", 5, 0.3),
        f"""p as (select q.vec_id as id, e.label, round({_COS.format(a='q.embedding', b='e.embedding')}, 6) as sim, e.vec_id as nid from embeddings q join embeddings e on e.vec_id % 5 <> 0 where q.vec_id % 5 = 0),
        k as (select *, row_number() over (partition by id order by sim desc, nid) as i from p), v as (select id, label, sum(greatest(0, least(1, sim))) as w from k where i <= 5 group by id, label),
        b as (select *, sum(w) over (partition by id) as t, row_number() over (partition by id order by w desc, label) as i from v)
        select id, label, {r('w / t')} as confidence from b where i = 1 and t > 0 and round(w / t, 4) >= 0.3""",
    ),
    "shift_similarity": (
        shifted,
        f"""v as (select vec_id, embedding[1:12]::double[] as v from embeddings), w as (select v as w from v where vec_id = 0),
        s as (select vec_id, list_max(list_transform(range(12), lambda i: list_dot_product(v, list_concat(w[i + 1:12], w[1:i])))) / nullif(sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(w, w)), 0) as x from v, w)
        select vec_id, {r('x')} as similarity from s""",
    ),
}
