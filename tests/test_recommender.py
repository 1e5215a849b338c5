"""T3/T4/T5: the pruned batch plan against an independent per-user evaluation."""

import math
import random

import numpy as np
import pandas as pd

from aularank.params import RecommenderParams
from aularank.plans import recommend as rp
from aularank.sources.enrolments import clean_enrolments

AUD = ["TODOS", "todos", "PRIMARIA, INICIAL", "SECUNDARIA", "", None]
LEVELS = ["PRIMARIA", "SECUNDARIA", "INICIAL", "", None]


def make_rows(seed, n_users=30, n_courses=18, n_rows=260):
    rnd = random.Random(seed)
    course = {f"C{c:02d}": (rnd.choice(AUD), rnd.choice([0, 1, 1, 1]), rnd.randint(2019, 2024))
              for c in range(n_courses)}
    user = {f"U{u:02d}": (rnd.choice(LEVELS), rnd.choice(["R1", "R2", "R3", "", None])) for u in range(n_users)}
    rows = []
    for i in range(n_rows):
        u, c = rnd.choice(list(user)), rnd.choice(list(course))
        lvl, reg = user[u]
        aud, act, year = course[c]
        rows.append((i, u, c, f"curso {c}", lvl, rnd.choice([0, 1]), act, year, rnd.choice([0.0, 0.5, 0.79, 0.8, 1.0]),
                     rnd.choice([None, 1.0, 3.5, 5.0]), rnd.choice(["SI", "NO", None]), reg, aud, 20.0))
    # a user who took every course, and a user with only zero ratings
    for j, c in enumerate(course):
        aud, act, year = course[c]
        rows.append((n_rows + j, "UALL", c, f"curso {c}", "PRIMARIA", 0, act, year, 0.0, None, "NO", "R1", aud, 20.0))
    return rows


SCHEMA = ("ORD long, USUARIO_DOCUMENTO string, ID_OFERTA_FORMATIVA string, CURSO string, NIVELNEXUS string, "
          "APROBACION int, ACTIVO int, `AÑO` int, PORCENTAJE_AVANCE double, CALIFICACIONES double, "
          "CURSO_CULMINADO string, NOMBRE_DRE string, PUBLICO_OBJETIVO string, HORAS_PROGRAMA double")


def r4(x):
    return math.copysign(math.floor(abs(x) * 1e4 + 0.5) / 1e4, x)


def python_reference(df: pd.DataFrame, p: RecommenderParams):
    """Per-user evaluation written from the semantics, one user at a time."""
    df = df.sort_values("ord")
    cat = {}
    for c, g in df.groupby("ID_OFERTA_FORMATIVA"):
        n = g["USUARIO_DOCUMENTO"].notna().sum()
        tc = min(max(g["CURSO_CULMINADO"].sum() / n, 0), 1) if n else 0.0
        mean = g["CALIFICACIONES"].mean()
        cn = min(max((0.0 if pd.isna(mean) else mean) / 5.0, 0), 1)
        cat[c] = dict(active=g["ACTIVO"].max(), year=g["AÑO"].max(), aud=g["PUBLICO_OBJETIVO"].iloc[0],
                      pop=r4(tc * cn * math.log1p(n)))
    newest = max(v["year"] for v in cat.values())
    for v in cat.values():
        age = newest - v["year"]
        v["nov"] = 1.0 if age == 0 else 0.6 if age == 1 else 0.3 if age == 2 else 0.1
    rat = df.groupby(["USUARIO_DOCUMENTO", "ID_OFERTA_FORMATIVA"])["RATING_COMPUESTO"].max().unstack(fill_value=0.0)
    users, courses = list(rat.index), list(rat.columns)
    m = rat.to_numpy()
    norm = np.sqrt((m * m).sum(1))
    sim = (m @ m.T) / np.where(np.outer(norm, norm) == 0, 1, np.outer(norm, norm))
    sim[np.outer(norm, norm) == 0] = 0
    out = []
    for ui, u in enumerate(users):
        mine = df[df["USUARIO_DOCUMENTO"] == u]
        taken = set(mine["ID_OFERTA_FORMATIVA"])
        order = sorted([v for v in range(len(users)) if v != ui], key=lambda v: (-sim[ui, v], users[v]))
        nbr = [v for v in order[: p.similar_users] if sim[ui, v] > 0]
        S = {}
        for ci, c in enumerate(courses):
            if c in taken:
                continue
            val = sum(sim[ui, v] * m[v, ci] for v in nbr)
            if val > 0:
                S[c] = val
        colab = {}
        if S:
            mx = max(S.values())
            ranked = sorted(S, key=lambda c: (-round(S[c] / mx, 9), c))[: p.expand]
            colab = {c: S[c] / mx for c in ranked}
        cand = [c for c, v in cat.items() if v["active"] == 1 and c not in taken]
        mp = max((cat[c]["pop"] for c in cand), default=None)
        pop = {c: min(max(cat[c]["pop"] / mp, 0), 1) for c in cand} if mp else {}
        hist = {}
        if cand:
            lvl, reg = mine["NIVELNEXUS"].iloc[0], mine["NOMBRE_DRE"].iloc[0]
            m1 = mp if mp else 1.0
            sc = {}
            for c in cand:
                b = min(max(cat[c]["pop"] / m1, 0), 1)
                aud = (cat[c]["aud"] or "").upper()
                if lvl is None:
                    match = aud == "TODOS"
                elif lvl == "":
                    match = False
                else:
                    match = lvl.upper() in aud or aud == "TODOS"
                sc[c] = min(max(b * (1.3 if match else 1.0), 0), 1)
            if reg:
                peers = df[(df["NOMBRE_DRE"] == reg) & (df["USUARIO_DOCUMENTO"] != u) & (df["CURSO_CULMINADO"] == 1)]
                if len(peers):
                    freq = peers["ID_OFERTA_FORMATIVA"].value_counts(normalize=True)
                    for c, f in freq.items():
                        if c in sc:
                            sc[c] = min(max(sc[c] + f * 0.5, 0), 1)
            hist = {c: sc[c] for c in sorted(sc, key=lambda c: (-sc[c], c))[: p.expand]}
        nov = {c: cat[c]["nov"] for c in cand}
        keys = set(colab) | set(pop) | set(hist) | set(nov)
        res = []
        for c in keys:
            s = (((colab.get(c, 0.0) * p.w_collaborative) + (pop.get(c, 0.0) * p.w_popularity))
                 + (hist.get(c, 0.0) * p.w_history)) + (nov.get(c, 0.0) * p.w_novelty)
            if s >= p.min_score:
                res.append((c, r4(s)))
        if res:
            res.sort(key=lambda x: (-x[1], x[0]))
            out += [(u, i + 1, c, s) for i, (c, s) in enumerate(res[: p.top_k])]
        else:
            fb = sorted(cand, key=lambda c: (-cat[c]["pop"], c))[: p.top_k]
            out += [(u, i + 1, c, r4(cat[c]["pop"])) for i, c in enumerate(fb)]
    return sorted(out)


def run_case(spark, seed, params):
    raw = spark.createDataFrame(make_rows(seed), SCHEMA)
    enrol = clean_enrolments(raw)
    recs = rp.recommend(rp.build_model(enrol, params, checkpoint=False), None, params)
    got = sorted((r.USUARIO_DOCUMENTO, r.posicion, r.ID_OFERTA_FORMATIVA, r.score_final) for r in recs.collect())
    pdf = enrol.toPandas()
    return got, python_reference(pdf, params), recs


def test_hybrid_matches_per_user_evaluation(spark):
    for seed in (1, 2):
        got, want, recs = run_case(spark, seed, RecommenderParams(hot_raters=6))
        assert got == want
        # T5 invariants: positions contiguous, no taken course, <= top_k per user
        pdf = recs.toPandas()
        for _, g in pdf.groupby("USUARIO_DOCUMENTO"):
            assert sorted(g["posicion"]) == list(range(1, len(g) + 1)) and len(g) <= 3


def test_fallback_when_nothing_passes_min_score(spark):
    got, want, recs = run_case(spark, 3, RecommenderParams(min_score=1.01, hot_raters=6))
    assert got == want
    assert all(m == ["popularidad_fallback"] for m in recs.toPandas()["metodos_usados"].map(list))


def test_per_request_top_k_and_subset_equals_all(spark):
    """SRC-6 / FLT-13 and T4: a users subset with per-request k equals all users cut at k."""
    from pyspark.sql import functions as F

    params = RecommenderParams(hot_raters=6)
    enrol = clean_enrolments(spark.createDataFrame(make_rows(4), SCHEMA))
    model = rp.build_model(enrol, params, checkpoint=False)
    full5 = rp.recommend(model, None, RecommenderParams(top_k=5, hot_raters=6))
    req = spark.createDataFrame([("U01", 5), ("U02", None), ("U03", -1), ("NOBODY", 2)], "USUARIO_DOCUMENTO string, top_k int")
    got = rp.recommend(model, req, params)
    rows = {(r.USUARIO_DOCUMENTO, r.posicion): r.ID_OFERTA_FORMATIVA for r in got.collect()}
    want5 = {(r.USUARIO_DOCUMENTO, r.posicion): r.ID_OFERTA_FORMATIVA
             for r in full5.where(F.col("USUARIO_DOCUMENTO") == "U01").collect()}
    assert {k: v for k, v in rows.items() if k[0] == "U01"} == want5
    full3 = {(r.USUARIO_DOCUMENTO, r.posicion): r.ID_OFERTA_FORMATIVA
             for r in rp.recommend(model, None, params).where(F.col("USUARIO_DOCUMENTO").isin("U02", "U03")).collect()}
    assert {k: v for k, v in rows.items() if k[0] in ("U02", "U03")} == full3
    assert len([k for k in rows if k[0] == "NOBODY"]) == 2  # unknown user: popularity + novelty only
