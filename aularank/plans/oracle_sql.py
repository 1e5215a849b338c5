"""DuckDB oracle SQL for the registered queries.

Written independently of the Spark plans: brute force where Spark prunes
(users x active catalog, all user pairs over shared courses), so agreement is
evidence that the pruned Spark plans are exact.  The views ``lineitem orders
customer nation region part events documents embeddings ...`` are registered
by the checker.  DuckDB reads ``0.5`` as DECIMAL, so literals that take part
in double arithmetic are cast.
"""

from __future__ import annotations

from aularank.fixed_values import PROMPT_BASE, PROMPT_ROUTER, PROMPT_SIFODS
from aularank.functions.columns import TOKEN_PATTERN
from aularank.params import RecommenderParams

D = "::DOUBLE"


def _first(col: str) -> str:
    """The first non-null value in source order."""
    return f"arg_min({col}, ord) FILTER (WHERE {col} IS NOT NULL) AS {col}"


# FIXTURES B1 + cleaning rules (values of the fixture are already in range).
ENROL = f"""
enrol AS (
  SELECT
    CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS ord,
    CAST(year(o_orderdate) - p_partkey % 4 AS INTEGER) AS "AÑO",
    o_orderpriority AS TIPO_CONSTANCIA,
    p_name || ' ' || CAST(p_partkey AS VARCHAR) || CASE WHEN l_linenumber % 3 = 0 THEN ' (rev)' ELSE '' END AS CURSO,
    CASE WHEN l_orderkey % 11 <> 0 THEN n_name END AS NOMBRE_DRE,
    r_name AS NOMBRE_UGEL,
    CAST(o_custkey AS VARCHAR) AS USUARIO_DOCUMENTO,
    c_name AS NOMBRE_COMPLETO,
    CASE WHEN l_orderkey % 9 <> 0 THEN c_mktsegment END AS NIVELNEXUS,
    CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS APROBACION,
    CAST(l_partkey AS VARCHAR) AS ID_OFERTA_FORMATIVA,
    CAST(l_suppkey AS VARCHAR) AS ID_GRUPO,
    CAST(NULL AS VARCHAR) AS FECHA_NACIMIENTO,
    CAST(p_size % 2 AS INTEGER) AS ES_FOCALIZADO,
    CAST(p_size + l_linenumber % 2 AS DOUBLE) AS HORAS_PROGRAMA,
    least(greatest(l_quantity / 10, 0{D}), 5{D}) AS CALIFICACIONES,
    CASE WHEN l_linenumber % 4 <> 1 THEN p_brand || ' ' || p_type END AS PROPOSITO,
    CASE WHEN p_size % 5 <> 0 THEN 1 ELSE 0 END AS ACTIVO,
    CASE WHEN l_linenumber % 5 <> 2 THEN CASE p_type WHEN 'PROMO' THEN 'TODOS' WHEN 'ECONOMY' THEN 'BUILDING, HOUSEHOLD'
      WHEN 'MEDIUM' THEN 'MACHINERY' WHEN 'STANDARD' THEN 'AUTOMOBILE' WHEN 'SMALL' THEN 'FURNITURE'
      ELSE '' END END AS PUBLICO_OBJETIVO,
    CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS CURSO_CULMINADO,
    CAST(25 + o_custkey % 40 AS DOUBLE) AS EDAD,
    least(greatest(l_discount * 10, 0{D}), 1{D}) AS PORCENTAJE_AVANCE
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey
),
enrol_r AS (
  SELECT *, round(least(greatest(
      (CASE WHEN CURSO_CULMINADO = 1 THEN 2.5{D} ELSE 0{D} END)
    + (CASE WHEN CURSO_CULMINADO <> 1 AND APROBACION = 1 THEN 1.5{D} ELSE 0{D} END)
    + (CASE WHEN CURSO_CULMINADO <> 1 AND PORCENTAJE_AVANCE >= 0.8{D} THEN 1.0{D} ELSE 0{D} END)
    + (CASE WHEN CURSO_CULMINADO <> 1 AND PORCENTAJE_AVANCE >= 0.5{D} AND PORCENTAJE_AVANCE < 0.8{D}
            THEN 0.5{D} ELSE 0{D} END), 0{D}), 5{D}), 4) AS RATING_COMPUESTO
  FROM enrol
)"""

# The fixture's text export: aliases, blanks, non-numbers, absent optional columns.
TEXT_ENROL = """
text_enrol AS (
  SELECT *, CASE WHEN CURSO_CULMINADO = 1 THEN 2.5::DOUBLE WHEN APROBACION = 1 THEN 1.5::DOUBLE ELSE 0::DOUBLE END AS raw FROM (
    SELECT ord, USUARIO_DOCUMENTO, ID_OFERTA_FORMATIVA, CURSO, NIVELNEXUS, "AÑO", APROBACION,
      CASE WHEN part % 3 = 0 THEN 0 ELSE ACTIVO END AS ACTIVO,
      CASE WHEN part % 10 = 0 THEN 0::DOUBLE ELSE HORAS_PROGRAMA + 0.5::DOUBLE END AS HORAS_PROGRAMA,
      CASE WHEN part % 7 <> 0 THEN trunc(CALIFICACIONES) END AS CALIFICACIONES,
      1 - APROBACION AS CURSO_CULMINADO,
      0::DOUBLE AS PORCENTAJE_AVANCE, NULL::DOUBLE AS EDAD, '' AS NOMBRE_DRE
    FROM (SELECT e.*, CAST(ID_OFERTA_FORMATIVA AS BIGINT) AS part FROM enrol e))
)"""

CATALOG = f"""
cat0 AS (
  SELECT ID_OFERTA_FORMATIVA,
    {_first("CURSO")}, {_first("HORAS_PROGRAMA")}, {_first("PROPOSITO")},
    {_first("PUBLICO_OBJETIVO")}, max("AÑO") AS "AÑO_MAX", max(ACTIVO) AS ACTIVO,
    count(USUARIO_DOCUMENTO) AS TOTAL_INSCRITOS,
    CAST(sum(CURSO_CULMINADO) AS BIGINT) AS TOTAL_CULMINADOS,
    CAST(sum(APROBACION) AS BIGINT) AS TOTAL_APROBADOS,
    avg(CALIFICACIONES) AS CALIFICACION_PROM
  FROM enrol_r WHERE ID_OFERTA_FORMATIVA IS NOT NULL GROUP BY ID_OFERTA_FORMATIVA
),
cat1 AS (
  SELECT *,
    least(greatest(coalesce(TOTAL_CULMINADOS{D} / nullif(TOTAL_INSCRITOS, 0), 0{D}), 0{D}), 1{D}) AS TASA_CULMINACION,
    least(greatest(coalesce(TOTAL_APROBADOS{D} / nullif(TOTAL_INSCRITOS, 0), 0{D}), 0{D}), 1{D}) AS TASA_APROBACION,
    least(greatest(coalesce(CALIFICACION_PROM, 0{D}) / 5{D}, 0{D}), 1{D}) AS CALIFICACION_NORM
  FROM cat0
),
catalog AS (
  SELECT *,
    round(TASA_CULMINACION * CALIFICACION_NORM * ln(1 + TOTAL_INSCRITOS{D}), 4) AS SCORE_POPULARIDAD,
    CASE max("AÑO_MAX") OVER () - "AÑO_MAX" WHEN 0 THEN 1.0{D} WHEN 1 THEN 0.6{D} WHEN 2 THEN 0.3{D}
      ELSE 0.1{D} END AS SCORE_NOVEDAD
  FROM cat1
)"""

PROFILE = f"""
profile AS (
  SELECT USUARIO_DOCUMENTO,
    {_first("NOMBRE_COMPLETO")}, {_first("NIVELNEXUS")}, {_first("NOMBRE_DRE")},
    {_first("NOMBRE_UGEL")}, min(EDAD) AS EDAD_APROX,
    count(ID_OFERTA_FORMATIVA) AS TOTAL_CURSOS,
    CAST(sum(CURSO_CULMINADO) AS BIGINT) AS CURSOS_CULMINADOS,
    CAST(sum(APROBACION) AS BIGINT) AS CURSOS_APROBADOS,
    round(coalesce(sum(CURSO_CULMINADO){D} / nullif(count(ID_OFERTA_FORMATIVA), 0), 0{D}), 4) AS TASA_COMPLETITUD
  FROM enrol_r WHERE USUARIO_DOCUMENTO IS NOT NULL GROUP BY USUARIO_DOCUMENTO
)"""

RATINGS = """
ratings AS (
  SELECT USUARIO_DOCUMENTO, ID_OFERTA_FORMATIVA, max(RATING_COMPUESTO) AS rating
  FROM enrol_r WHERE USUARIO_DOCUMENTO IS NOT NULL AND ID_OFERTA_FORMATIVA IS NOT NULL
  GROUP BY USUARIO_DOCUMENTO, ID_OFERTA_FORMATIVA
),
taken AS (
  SELECT DISTINCT USUARIO_DOCUMENTO, ID_OFERTA_FORMATIVA FROM enrol_r
  WHERE USUARIO_DOCUMENTO IS NOT NULL AND ID_OFERTA_FORMATIVA IS NOT NULL
)"""


# A few courses with most of the raters, beside every fourth course as it is.
SKEWED = """
skewed AS (
  SELECT USUARIO_DOCUMENTO, max(rating) AS rating,
    CASE WHEN CAST(ID_OFERTA_FORMATIVA AS BIGINT) % 4 = 0 THEN ID_OFERTA_FORMATIVA
      ELSE 'f' || CAST((CAST(ID_OFERTA_FORMATIVA AS BIGINT) % 100) * (CAST(ID_OFERTA_FORMATIVA AS BIGINT) % 100)
                       * (CAST(ID_OFERTA_FORMATIVA AS BIGINT) % 100) // 10000 AS VARCHAR) END AS ID_OFERTA_FORMATIVA
  FROM ratings GROUP BY ALL
)"""


def neighbours_cte(n: int, source: str = "ratings") -> str:
    return f"""
pos AS (SELECT * FROM {source} WHERE rating > 0),
nrm AS (SELECT USUARIO_DOCUMENTO AS u, sum(rating * rating) AS n2 FROM pos GROUP BY 1),
dots AS (
  SELECT a.USUARIO_DOCUMENTO AS u, b.USUARIO_DOCUMENTO AS v, sum(a.rating * b.rating) AS dot
  FROM pos a JOIN pos b ON a.ID_OFERTA_FORMATIVA = b.ID_OFERTA_FORMATIVA
   AND a.USUARIO_DOCUMENTO <> b.USUARIO_DOCUMENTO
  GROUP BY 1, 2
),
sims AS (
  SELECT d.u, d.v, d.dot / (sqrt(x.n2) * sqrt(y.n2)) AS sim
  FROM dots d JOIN nrm x ON d.u = x.u JOIN nrm y ON d.v = y.u
),
neighbours AS (
  SELECT u AS USUARIO_DOCUMENTO, v AS neighbour, sim,
         row_number() OVER (PARTITION BY u ORDER BY sim DESC, v ASC) AS rank
  FROM sims QUALIFY rank <= {n}
)"""


def collaborative_cte(expand: int | str, req: str = "") -> str:
    """``req``: a join that brings the user's own ``k`` (then ``expand`` is an expression of it)."""
    return f"""
cs AS (
  SELECT n.USUARIO_DOCUMENTO, r.ID_OFERTA_FORMATIVA, sum(n.sim * r.rating) AS S
  FROM neighbours n JOIN ratings r ON r.USUARIO_DOCUMENTO = n.neighbour
  WHERE r.rating > 0 GROUP BY 1, 2
),
cs2 AS (
  SELECT cs.* FROM cs LEFT JOIN taken t
    ON t.USUARIO_DOCUMENTO = cs.USUARIO_DOCUMENTO AND t.ID_OFERTA_FORMATIVA = cs.ID_OFERTA_FORMATIVA
  WHERE t.USUARIO_DOCUMENTO IS NULL AND cs.S > 0
),
collab AS (
  SELECT USUARIO_DOCUMENTO, ID_OFERTA_FORMATIVA,
         S / max(S) OVER (PARTITION BY USUARIO_DOCUMENTO) AS score
  FROM cs2
),
collab_top AS (
  SELECT *, row_number() OVER (PARTITION BY USUARIO_DOCUMENTO
            ORDER BY round(score, 9) DESC, ID_OFERTA_FORMATIVA ASC) AS rank
  FROM collab {req} QUALIFY rank <= {expand}
)"""


# Users x active untaken courses: the brute-force candidate table.
CANDIDATES = """
users AS (SELECT DISTINCT USUARIO_DOCUMENTO FROM enrol_r WHERE USUARIO_DOCUMENTO IS NOT NULL),
active AS (SELECT * FROM catalog WHERE ACTIVO = 1),
ua AS (
  SELECT u.USUARIO_DOCUMENTO, a.ID_OFERTA_FORMATIVA, a.SCORE_POPULARIDAD, a.SCORE_NOVEDAD, a.PUBLICO_OBJETIVO
  FROM users u CROSS JOIN active a
  LEFT JOIN taken t ON t.USUARIO_DOCUMENTO = u.USUARIO_DOCUMENTO AND t.ID_OFERTA_FORMATIVA = a.ID_OFERTA_FORMATIVA
  WHERE t.USUARIO_DOCUMENTO IS NULL
),
maxpop AS (SELECT USUARIO_DOCUMENTO, max(SCORE_POPULARIDAD) AS max_pop FROM ua GROUP BY 1)"""


def history_cte(expand: int | str, p: RecommenderParams, req: str = "") -> str:
    return f"""
firstrow AS (
  SELECT USUARIO_DOCUMENTO, first(NIVELNEXUS ORDER BY ord) AS level, first(NOMBRE_DRE ORDER BY ord) AS region
  FROM enrol_r WHERE USUARIO_DOCUMENTO IS NOT NULL GROUP BY 1
),
done AS (SELECT * FROM enrol_r WHERE CURSO_CULMINADO = 1 AND ID_OFERTA_FORMATIVA IS NOT NULL),
nd AS (SELECT NOMBRE_DRE AS region, count(*) AS N_d FROM done GROUP BY 1),
own AS (SELECT USUARIO_DOCUMENTO, NOMBRE_DRE AS region, count(*) AS own FROM done GROUP BY 1, 2),
ndc AS (
  SELECT NOMBRE_DRE AS region, ID_OFERTA_FORMATIVA, count(*) AS n_dc FROM done
  WHERE NOMBRE_DRE IS NOT NULL AND NOMBRE_DRE <> '' GROUP BY 1, 2
),
ctx AS (
  SELECT f.USUARIO_DOCUMENTO, f.level,
    CASE WHEN f.region IS NOT NULL AND f.region <> '' THEN f.region END AS region,
    CASE WHEN m.max_pop > 0 THEN m.max_pop ELSE 1{D} END AS m1,
    coalesce(nd.N_d, 0) - coalesce(own.own, 0) AS D
  FROM firstrow f JOIN maxpop m USING (USUARIO_DOCUMENTO)
  LEFT JOIN nd ON nd.region = f.region
  LEFT JOIN own ON own.USUARIO_DOCUMENTO = f.USUARIO_DOCUMENTO AND own.region = f.region
),
hist0 AS (
  SELECT ua.USUARIO_DOCUMENTO, ua.ID_OFERTA_FORMATIVA, c.region, c.D, ndc.n_dc,
    least(greatest(ua.SCORE_POPULARIDAD / c.m1, 0{D}), 1{D}) AS b0,
    CASE WHEN c.level IS NULL THEN upper(ua.PUBLICO_OBJETIVO) = 'TODOS'
         WHEN c.level = '' THEN false
         ELSE contains(upper(ua.PUBLICO_OBJETIVO), upper(c.level)) OR upper(ua.PUBLICO_OBJETIVO) = 'TODOS'
    END AS matched
  FROM ua JOIN ctx c USING (USUARIO_DOCUMENTO)
  LEFT JOIN ndc ON ndc.region = c.region AND ndc.ID_OFERTA_FORMATIVA = ua.ID_OFERTA_FORMATIVA
),
hist1 AS (
  SELECT *, least(greatest(CASE WHEN matched THEN b0 * {p.audience_bonus}{D} ELSE b0 END, 0{D}), 1{D}) AS b
  FROM hist0
),
hist2 AS (
  SELECT USUARIO_DOCUMENTO, ID_OFERTA_FORMATIVA,
    CASE WHEN region IS NOT NULL AND D > 0 AND n_dc IS NOT NULL
         THEN least(greatest(b + (n_dc{D} / D) * {p.region_weight}{D}, 0{D}), 1{D}) ELSE b END AS score
  FROM hist1
),
hist_top AS (
  SELECT *, row_number() OVER (PARTITION BY USUARIO_DOCUMENTO
            ORDER BY score DESC, ID_OFERTA_FORMATIVA ASC) AS rank
  FROM hist2 {req} QUALIFY rank <= {expand}
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


def recommend_sql(p: RecommenderParams = RecommenderParams()) -> str:
    return with_(*recommend_ctes(p)) + " SELECT * FROM final"


def requests_sql(p: RecommenderParams = RecommenderParams()) -> str:
    """Every customer's own number of courses; only users with enrolments can be served."""
    req = f"""
req AS (
  SELECT CAST(c_custkey AS VARCHAR) AS USUARIO_DOCUMENTO,
    CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 7 - 2 > 0 THEN c_custkey % 7 - 2 ELSE {p.top_k} END AS k
  FROM customer
)"""
    return with_(*recommend_ctes(p, req)) + " SELECT * FROM final"


def recommend_ctes(p: RecommenderParams = RecommenderParams(), requests: str = "") -> tuple:
    """``requests``: a CTE ``req`` (user, k) of users' own numbers of courses; else every user gets ``top_k``."""
    k, e, req = p.top_k, p.expand, ""
    if requests:
        k, e, req = "k", f"{p.expand_factor} * k", "JOIN req USING (USUARIO_DOCUMENTO)"
    blend = (f"(((raw_c * {p.w_collaborative}{D}) + (raw_p * {p.w_popularity}{D})) "
             f"+ (raw_h * {p.w_history}{D})) + (raw_n * {p.w_novelty}{D})")
    return (
        ENROL, CATALOG, RATINGS, *([requests] if requests else []), neighbours_cte(p.similar_users), collaborative_cte(e, req), CANDIDATES,
        history_cte(e, p, req),
        f"""
cand AS (
  SELECT USUARIO_DOCUMENTO, ID_OFERTA_FORMATIVA FROM ua
  UNION SELECT USUARIO_DOCUMENTO, ID_OFERTA_FORMATIVA FROM collab_top
),
parts AS (
  SELECT c.USUARIO_DOCUMENTO, c.ID_OFERTA_FORMATIVA,
    coalesce(ct.score, 0{D}) AS raw_c,
    CASE WHEN cat.ACTIVO = 1 AND m.max_pop > 0
         THEN least(greatest(cat.SCORE_POPULARIDAD / m.max_pop, 0{D}), 1{D}) ELSE 0{D} END AS raw_p,
    coalesce(ht.score, 0{D}) AS raw_h,
    CASE WHEN cat.ACTIVO = 1 THEN cat.SCORE_NOVEDAD ELSE 0{D} END AS raw_n
  FROM cand c
  LEFT JOIN collab_top ct USING (USUARIO_DOCUMENTO, ID_OFERTA_FORMATIVA)
  LEFT JOIN hist_top ht USING (USUARIO_DOCUMENTO, ID_OFERTA_FORMATIVA)
  LEFT JOIN maxpop m USING (USUARIO_DOCUMENTO)
  LEFT JOIN catalog cat USING (ID_OFERTA_FORMATIVA)
),
scored AS (SELECT *, {blend} AS score FROM parts),
top AS (
  SELECT *, row_number() OVER (PARTITION BY USUARIO_DOCUMENTO
            ORDER BY round(score, 4) DESC, ID_OFERTA_FORMATIVA ASC) AS posicion
  FROM scored {req} WHERE score >= {p.min_score}{D} QUALIFY posicion <= {k}
),
hybrid AS (
  SELECT USUARIO_DOCUMENTO, CAST(posicion AS INTEGER) AS posicion, ID_OFERTA_FORMATIVA,
    round(score, 4) AS score_final,
    round(raw_c * {p.w_collaborative}{D}, 4) AS score_colaborativo,
    round(raw_p * {p.w_popularity}{D}, 4) AS score_popularidad,
    round(raw_h * {p.w_history}{D}, 4) AS score_historial,
    round(raw_n * {p.w_novelty}{D}, 4) AS score_novedad,
    concat_ws(',',
      CASE WHEN raw_c > 0 THEN 'colaborativo' END, CASE WHEN raw_p > 0 THEN 'popularidad' END,
      CASE WHEN raw_h > 0 THEN 'historial' END, CASE WHEN raw_n > 0 THEN 'novedad' END) AS metodos,
    'Curso relevante para tu nivel educativo y región. Docentes con tu perfil lo completaron con alta valoración.'
      AS justificacion
  FROM top
),
fb AS (
  SELECT ua.USUARIO_DOCUMENTO, ua.ID_OFERTA_FORMATIVA, ua.SCORE_POPULARIDAD,
    row_number() OVER (PARTITION BY ua.USUARIO_DOCUMENTO
                       ORDER BY ua.SCORE_POPULARIDAD DESC, ua.ID_OFERTA_FORMATIVA ASC) AS posicion
  FROM ua {req} WHERE ua.USUARIO_DOCUMENTO NOT IN (SELECT USUARIO_DOCUMENTO FROM hybrid)
  QUALIFY posicion <= {k}
),
recs AS (
  SELECT * FROM hybrid
  UNION ALL
  SELECT USUARIO_DOCUMENTO, CAST(posicion AS INTEGER), ID_OFERTA_FORMATIVA, round(SCORE_POPULARIDAD, 4),
    NULL{D}, NULL{D}, NULL{D}, NULL{D}, 'popularidad_fallback',
    'Curso muy valorado por docentes de la plataforma.'
  FROM fb
)""", """
final AS (
  SELECT r.*, c.CURSO, CAST(trunc(c.HORAS_PROGRAMA) AS INTEGER) AS HORAS_PROGRAMA,
    substring(coalesce(c.PROPOSITO, ''), 1, 300) AS PROPOSITO, c.PUBLICO_OBJETIVO,
    CAST(c."AÑO_MAX" AS INTEGER) AS "AÑO", CAST(c.TOTAL_INSCRITOS AS INTEGER) AS TOTAL_INSCRITOS,
    round(c.TASA_CULMINACION, 2) AS TASA_CULMINACION, round(c.TASA_APROBACION, 2) AS TASA_APROBACION,
    round(c.CALIFICACION_PROM, 2) AS CALIFICACION_PROM
  FROM recs r LEFT JOIN catalog c USING (ID_OFERTA_FORMATIVA)
)""")


# ---- logs (FIXTURES B3) --------------------------------------------------------

LOG = """
log AS (
  SELECT CAST(event_id AS BIGINT) AS id, CAST(user_id AS VARCHAR) AS usuario,
    'user ' || CAST(user_id AS VARCHAR) AS nombre_usuario,
    'mensaje ' || CAST(event_id AS VARCHAR) AS mensaje,
    'respuesta ' || CAST(event_id AS VARCHAR) AS respuesta,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 'recomendacion' ELSE 'sifods' END AS tarea,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 'modelo_recomendacion_hibrido' ELSE 'qdrant' END
      AS fuente_datos,
    CASE WHEN event_type <> 'error' THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS tokens_entrada,
    CASE WHEN event_type <> 'error' THEN 2 * CAST(json_extract_string(props, '$.k') AS INTEGER) END AS tokens_salida,
    CASE WHEN event_type <> 'error' THEN CAST(floor(value * 10) AS INTEGER) END AS latencia_ms,
    ts AS "timestamp"
  FROM events
)"""

DETAILS = """
det AS (
  SELECT CAST(event_id * 10 + p AS BIGINT) AS id, CAST(event_id AS BIGINT) AS conversacion_id,
    CAST(user_id AS VARCHAR) AS usuario, CAST(p AS SMALLINT) AS posicion,
    CAST((event_id * p) % 200 AS VARCHAR) AS id_oferta_formativa,
    'curso ' || CAST((event_id * p) % 200 AS VARCHAR) AS curso,
    CAST(p * 10 AS INTEGER) AS horas_programa, 'TODOS' AS publico_objetivo,
    CAST(0.5 AS DECIMAL(4,2)) AS tasa_culminacion, CAST(0.25 AS DECIMAL(4,2)) AS tasa_aprobacion,
    CAST(3.5 AS DECIMAL(3,1)) AS calificacion_prom, CAST(1.0 / p AS DECIMAL(6,4)) AS score_final,
    'popularidad,novedad' AS algoritmos_usados,
    'justificacion ' || CAST((event_id * p) % 200 AS VARCHAR) AS justificacion,
    ts AS "timestamp"
  FROM events, (VALUES (1), (2), (3)) v(p)
  WHERE event_type IN ('purchase', 'signup')
)"""

DIRTY = """
dirty_log AS (
  SELECT * REPLACE (
    CASE WHEN id % 97 = 0 THEN NULL WHEN id % 61 = 0 THEN repeat('u', 101) ELSE usuario END AS usuario,
    CASE WHEN id % 101 <> 0 THEN mensaje END AS mensaje, CASE WHEN id % 103 <> 0 THEN respuesta END AS respuesta,
    CASE WHEN id % 107 = 0 THEN NULL WHEN id % 89 = 0 THEN 'otra' WHEN id % 59 = 0 THEN repeat('t', 21) ELSE tarea END AS tarea,
    CASE WHEN id % 83 = 0 THEN repeat('n', 201) ELSE nombre_usuario END AS nombre_usuario,
    CASE WHEN id % 53 = 0 THEN repeat('f', 51) ELSE fuente_datos END AS fuente_datos,
    CASE WHEN id % 79 = 0 THEN id - 1 ELSE id END AS id) FROM log
),
dirty_det AS (
  SELECT * REPLACE (
    CASE WHEN conversacion_id % 47 = 0 THEN conversacion_id * 10 ELSE id END AS id,
    CASE WHEN conversacion_id % 71 = 0 THEN -conversacion_id - 1 WHEN conversacion_id % 73 <> 0 THEN conversacion_id END AS conversacion_id,
    CASE WHEN conversacion_id % 43 = 0 THEN NULL WHEN conversacion_id % 41 = 0 THEN repeat('u', 101) ELSE usuario END AS usuario,
    CASE WHEN conversacion_id % 67 <> 0 THEN posicion END AS posicion,
    CASE WHEN conversacion_id % 37 = 0 THEN repeat('i', 51) ELSE id_oferta_formativa END AS id_oferta_formativa,
    CASE WHEN conversacion_id % 31 = 0 THEN repeat('c', 256) ELSE curso END AS curso,
    CASE WHEN conversacion_id % 29 = 0 THEN repeat('p', 201) ELSE publico_objetivo END AS publico_objetivo) FROM det
)"""

CONSTRAINTS = """
SELECT 'conversaciones_agente' AS tabla, r.regla, r.n FROM (
  SELECT unnest([
    {'regla': 'not_null:usuario', 'n': count(*) FILTER (WHERE usuario IS NULL)},
    {'regla': 'not_null:mensaje', 'n': count(*) FILTER (WHERE mensaje IS NULL)},
    {'regla': 'not_null:respuesta', 'n': count(*) FILTER (WHERE respuesta IS NULL)},
    {'regla': 'not_null:tarea', 'n': count(*) FILTER (WHERE tarea IS NULL)},
    {'regla': 'length:usuario>100', 'n': count(*) FILTER (WHERE length(usuario) > 100)},
    {'regla': 'length:nombre_usuario>200', 'n': count(*) FILTER (WHERE length(nombre_usuario) > 200)},
    {'regla': 'length:tarea>20', 'n': count(*) FILTER (WHERE length(tarea) > 20)},
    {'regla': 'length:fuente_datos>50', 'n': count(*) FILTER (WHERE length(fuente_datos) > 50)},
    {'regla': 'domain:tarea', 'n': count(*) FILTER (WHERE tarea NOT IN ('sifods', 'recomendacion'))}
  ], recursive := true) FROM log) r
UNION ALL
SELECT 'recomendaciones_detalle', r.regla, r.n FROM (
  SELECT unnest([
    {'regla': 'not_null:conversacion_id', 'n': count(*) FILTER (WHERE conversacion_id IS NULL)},
    {'regla': 'not_null:usuario', 'n': count(*) FILTER (WHERE usuario IS NULL)},
    {'regla': 'not_null:posicion', 'n': count(*) FILTER (WHERE posicion IS NULL)},
    {'regla': 'length:usuario>100', 'n': count(*) FILTER (WHERE length(usuario) > 100)},
    {'regla': 'length:id_oferta_formativa>50', 'n': count(*) FILTER (WHERE length(id_oferta_formativa) > 50)},
    {'regla': 'length:curso>255', 'n': count(*) FILTER (WHERE length(curso) > 255)},
    {'regla': 'length:publico_objetivo>200', 'n': count(*) FILTER (WHERE length(publico_objetivo) > 200)}
  ], recursive := true) FROM det) r
UNION ALL
SELECT 'conversaciones_agente', 'primary_key:id', count(*) FROM (SELECT id FROM log GROUP BY id HAVING count(*) > 1)
UNION ALL
SELECT 'recomendaciones_detalle', 'primary_key:id', count(*) FROM (SELECT id FROM det GROUP BY id HAVING count(*) > 1)
UNION ALL
SELECT 'recomendaciones_detalle', 'foreign_key:conversacion_id', count(*)
FROM det WHERE conversacion_id NOT IN (SELECT id FROM log)
"""


# ---- retrieval (FIXTURES B2) ------------------------------------------------------

def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def routing_ctes(r) -> tuple:
    fast = "'embeddings ⚡ (' || reason || ')'"
    llm = "'llm 🤖 (' || reason || ')'"
    return (f"""
flat AS (
  SELECT vec_id, label, unnest(generate_series(1, len(embedding))) AS i, unnest(embedding) AS x
  FROM embeddings
),
nodes AS (SELECT label, min(vec_id) AS node_vec_id FROM embeddings GROUP BY label),
nodevec AS (SELECT n.label, n.node_vec_id, f.i, f.x FROM nodes n JOIN flat f ON f.vec_id = n.node_vec_id),
qn AS (
  SELECT q.vec_id AS query_id, nv.label, nv.node_vec_id, sum(q.x::DOUBLE * nv.x::DOUBLE) AS score
  FROM flat q JOIN nodevec nv ON q.i = nv.i GROUP BY 1, 2, 3
),
cands AS (
  SELECT query_id, label, node_vec_id, score, 'kb_' || label AS knowledge_base, 'Nodo ' || label AS name,
    'Tema ' || label AS description, 'Raiz > Nodo ' || label AS path,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_vec_id ASC) AS rank
  FROM qn QUALIFY rank <= {r.candidates}
),
dec0 AS (
  SELECT query_id,
    max(CASE WHEN rank = 1 THEN score END) AS s1,
    coalesce(max(CASE WHEN rank = 2 THEN score END), 0::DOUBLE) AS s2,
    max(CASE WHEN rank = 1 THEN knowledge_base END) AS kb,
    max(CASE WHEN rank = 1 THEN name END) AS node,
    max(CASE WHEN rank = 1 THEN path END) AS path
  FROM cands GROUP BY query_id
),
dec1 AS (
  SELECT *, (s1 >= {r.high}::DOUBLE) OR NOT ((s1 < {r.low}::DOUBLE) OR (s1 - s2 < {r.gap}::DOUBLE)) AS fast_path,
    CASE WHEN s1 >= {r.high}::DOUBLE THEN 'score alto (' || printf('%.4f', s1) || ')'
         WHEN s1 < {r.low}::DOUBLE THEN 'score bajo (' || printf('%.4f', s1) || ')'
         WHEN s1 - s2 < {r.gap}::DOUBLE THEN 'empate (diff=' || printf('%.4f', s1 - s2) || ')'
         ELSE 'score ok (' || printf('%.4f', s1) || ')' END AS reason
  FROM dec0
),
decision AS (
  SELECT query_id, kb, node, path, CASE WHEN fast_path THEN {fast} ELSE {llm} END AS method,
    fast_path, round(s1, 4) AS score
  FROM dec1
)""",)


ESCALATION = """,
lines AS (
  SELECT query_id, string_agg('- ' || knowledge_base || ' | ' || name || ' | score: ' || printf('%.4f', score)
    || chr(10) || '  ' || description, chr(10) ORDER BY rank) AS cands_text
  FROM cands GROUP BY query_id
)
SELECT d.query_id, """ + _lit(PROMPT_ROUTER.split("{query}")[0]) + """ || coalesce(doc.text, '') || """ \
    + _lit(PROMPT_ROUTER.split("{query}")[1].split("{candidates}")[0]) + """ || l.cands_text || """ \
    + _lit(PROMPT_ROUTER.split("{candidates}")[1]) + """ AS prompt
FROM decision d JOIN lines l USING (query_id) LEFT JOIN documents doc ON doc.doc_id = d.query_id
WHERE NOT d.fast_path"""


def search_cte(r, general: bool = False) -> str:
    """``general``: every third label's chunks are in the general collection."""
    kb = "CASE WHEN f.label % 3 = 0 THEN 'general' ELSE 'kb_' || f.label END" if general else "'kb_' || f.label"
    return f"""
chunkvec AS (SELECT f.vec_id AS chunk_id, {kb} AS kb, f.i, f.x FROM flat f),
target AS (SELECT query_id, CASE WHEN kb IN (SELECT kb FROM chunkvec) THEN kb ELSE 'general' END AS kb FROM decision),
qc AS (
  SELECT q.vec_id AS query_id, c.chunk_id, d.kb, sum(q.x::DOUBLE * c.x::DOUBLE) AS score
  FROM flat q JOIN target d ON d.query_id = q.vec_id
  JOIN chunkvec c ON c.kb = d.kb AND c.i = q.i
  GROUP BY 1, 2, 3
),
top AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id ASC) AS rank
  FROM qc QUALIFY rank <= {r.chunk_top_k}
),
hits AS (
  SELECT t.query_id, CAST(t.rank AS INTEGER) AS rank, t.kb, coalesce(doc.source, '') AS filename,
    CAST(t.chunk_id AS BIGINT) AS chunk, coalesce(doc.text, '') AS text, round(t.score, 4) AS score
  FROM top t LEFT JOIN documents doc ON doc.doc_id = t.chunk_id
)"""


CONTEXT = """
ctx AS (
  SELECT query_id,
    string_agg('[' || filename || ']' || chr(10) || text || chr(10), chr(10) || chr(10) ORDER BY rank) AS context,
    count(*) AS n_chunks,
    string_agg(CASE WHEN rank <= 3 THEN filename || '=' || printf('%.4f', score) END, ';' ORDER BY rank)
      AS referencias
  FROM hits GROUP BY query_id
)"""

_PB = PROMPT_BASE.split("{context}")
_PBQ = _PB[1].split("{question}")
ANSWERS = """,
ans AS (
  SELECT e.vec_id AS query_id, """ + _lit(_PB[0]) + """ || c.context || """ + _lit(_PBQ[0]) \
    + """ || coalesce(doc.text, '') || """ + _lit(_PBQ[1]) + " || chr(10) || chr(10) || " + _lit(PROMPT_SIFODS) \
    + """ AS prompt, d.kb, d.node, c.referencias, c.n_chunks
  FROM embeddings e LEFT JOIN documents doc ON doc.doc_id = e.vec_id
  LEFT JOIN decision d ON d.query_id = e.vec_id LEFT JOIN ctx c ON c.query_id = e.vec_id
)
SELECT query_id, CASE WHEN n_chunks IS NOT NULL THEN prompt END AS prompt,
  CASE WHEN n_chunks IS NOT NULL THEN 'qdrant:' || kb ELSE 'ninguna' END AS fuente_datos,
  CASE WHEN n_chunks IS NOT NULL THEN node || ' (' || kb || ')' END AS nodo_navegacion,
  coalesce(referencias, '') AS referencias,
  CASE WHEN n_chunks IS NOT NULL THEN len(regexp_extract_all(prompt, """ + _lit(TOKEN_PATTERN) + """)) END
    AS tokens_entrada
FROM ans"""


# ---- recommendation texts ------------------------------------------------------

def fill_sql(template: str, **values: str) -> str:
    """``template.format(**values)`` as a SQL concatenation of literals and expressions."""
    import re as _re

    parts, pos = [], 0
    for m in _re.finditer(r"\{(\w+)\}", template):
        if m.start() > pos:
            parts.append(_lit(template[pos:m.start()]))
        parts.append("(" + values[m.group(1)] + ")")
        pos = m.end()
    if pos < len(template):
        parts.append(_lit(template[pos:]))
    return " || ".join(parts)


def _has(method: str) -> str:
    return f"list_contains(string_split(f.metodos, ','), '{method}')"


def justification_sql(p: RecommenderParams = RecommenderParams()) -> str:
    from aularank import fixed_values as fv

    reasons = ("coalesce(nullif(concat_ws('; ', " + ", ".join(
        f"CASE WHEN {_has(m)} THEN {_lit(fv.METHOD_PHRASES[m])} END" for m in fv.METHODS)
        + f"), ''), {_lit(fv.DEFAULT_REASON)})")
    ctx = fill_sql(
        fv.TEACHER_CONTEXT,
        nivel="trim(coalesce(pr.NIVELNEXUS, ''))", dre="trim(coalesce(pr.NOMBRE_DRE, ''))",
        n_cul="CAST(pr.CURSOS_CULMINADOS AS VARCHAR)", n_tot="CAST(pr.TOTAL_CURSOS AS VARCHAR)",
        tasa="printf('%.0f', pr.TASA_COMPLETITUD * 100)")
    age = fill_sql(fv.TEACHER_AGE, edad="CAST(CAST(trunc(pr.EDAD_APROX) AS BIGINT) AS VARCHAR)")
    teacher = (f"CASE WHEN pr.TOTAL_CURSOS IS NULL THEN {_lit(fv.GENERIC_TEACHER_CONTEXT)} ELSE ({ctx}) || "
               f"CASE WHEN pr.EDAD_APROX IS NOT NULL THEN ({age}) ELSE '' END END")
    cal = (f"CASE WHEN coalesce(f.CALIFICACION_PROM, 0) > 0 THEN printf('%.1f', f.CALIFICACION_PROM) || '/5.0' "
           f"ELSE {_lit(fv.NO_RATING_TEXT)} END")
    user_prompt = fill_sql(
        fv.PROMPT_JUSTIFICATION_USER, docente_contexto=teacher, curso="coalesce(f.CURSO, '')",
        horas="CAST(f.HORAS_PROGRAMA AS VARCHAR)", calificacion=cal,
        publico_objetivo="coalesce(f.PUBLICO_OBJETIVO, '')", proposito="substring(coalesce(f.PROPOSITO, ''), 1, 250)",
        tasa_culminacion="printf('%.0f', f.TASA_CULMINACION * 100)",
        tasa_aprobacion="printf('%.0f', f.TASA_APROBACION * 100)", razones=reasons)
    return with_(*recommend_ctes(p), PROFILE) + f"""
SELECT f.USUARIO_DOCUMENTO, f.ID_OFERTA_FORMATIVA, f.posicion,
  {_lit(fv.PROMPT_JUSTIFICATION_SYSTEM)} AS system_prompt, {user_prompt} AS user_prompt
FROM final f LEFT JOIN profile pr USING (USUARIO_DOCUMENTO)
WHERE f.metodos <> 'popularidad_fallback'"""


def response_sql(p: RecommenderParams = RecommenderParams()) -> str:
    from aularank import fixed_values as fv

    cal = "coalesce(f.CALIFICACION_PROM, 0)"
    block = " || ".join([
        fill_sql(fv.RESPONSE_ITEM_TITLE, i="CAST(f.posicion AS VARCHAR)", curso="coalesce(f.CURSO, 'Curso')"),
        fill_sql(fv.RESPONSE_ITEM_WHY, justificacion="f.justificacion"),
        fill_sql(fv.RESPONSE_ITEM_HOURS, horas="CAST(f.HORAS_PROGRAMA AS VARCHAR)"),
        fill_sql(fv.RESPONSE_ITEM_DONE, tasa="printf('%.0f', coalesce(f.TASA_CULMINACION, 0) * 100)"),
        f"CASE WHEN {cal} > 0 THEN " + fill_sql(fv.RESPONSE_ITEM_RATING, cal=f"printf('%.1f', {cal})")
        + " ELSE '' END",
        "chr(10)",
        "CASE WHEN coalesce(f.PUBLICO_OBJETIVO, '') <> '' THEN "
        + fill_sql(fv.RESPONSE_ITEM_AUDIENCE, publico="f.PUBLICO_OBJETIVO") + " ELSE '' END",
        fill_sql(fv.RESPONSE_ITEM_SCORE, score="printf('%.2f', f.score_final)"),
    ])
    return with_(*recommend_ctes(p)) + f""",
blocks AS (
  SELECT f.USUARIO_DOCUMENTO, string_agg({block}, '' ORDER BY f.posicion) AS body, count(*) AS total,
    sum(len(regexp_extract_all(f.justificacion, {_lit(TOKEN_PATTERN)}))) AS tokens_salida
  FROM final f GROUP BY 1
),
meth AS (
  SELECT USUARIO_DOCUMENTO, string_agg(DISTINCT m, ',' ORDER BY m) AS algoritmos
  FROM (SELECT USUARIO_DOCUMENTO, unnest(string_split(metodos, ',')) AS m FROM final) GROUP BY 1
)
SELECT u.USUARIO_DOCUMENTO,
  CASE WHEN b.total IS NULL THEN {_lit(fv.HELP_NO_RECOMMENDATIONS)}
       ELSE {_lit(fv.RESPONSE_HEADER)} || b.body || {_lit(fv.RESPONSE_FOOTER)} END AS respuesta,
  CAST(coalesce(b.total, 0) AS INTEGER) AS total, coalesce(m.algoritmos, '') AS algoritmos,
  CAST(coalesce(b.tokens_salida, 0) AS BIGINT) AS tokens_salida
FROM users u LEFT JOIN blocks b USING (USUARIO_DOCUMENTO) LEFT JOIN meth m USING (USUARIO_DOCUMENTO)"""

SEARCH_TEXTS = r"""
WITH texts AS (
  SELECT 'd' AS side, doc_id AS id, 'passage: ' || coalesce(text, '') AS t FROM documents
  UNION ALL SELECT 'q', item_id, 'query: ' || coalesce(text, '') FROM benchmark
),
words AS (SELECT side, id, unnest(regexp_extract_all(lower(t), '[\p{L}\p{N}]+')) AS w FROM texts),
tf AS (SELECT side, id, ('0x' || substr(md5(w), 1, 7))::BIGINT % 256 AS b, count(*) AS n FROM words GROUP BY ALL),
df AS (SELECT b, count(*) AS n FROM tf WHERE side = 'd' GROUP BY b),
idf AS (SELECT r.b, ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (coalesce(df.n, 0) + 1)) AS x FROM range(256) r(b) LEFT JOIN df USING (b)),
raw AS (SELECT side, id, b, tf.n + tf.n * idf.x AS v FROM tf JOIN idf USING (b)),
unit AS (SELECT side, id, b, CAST(v / sqrt(sum(v * v) OVER (PARTITION BY side, id)) AS FLOAT) AS v FROM raw),
hit AS (
  SELECT q.id AS item_id, d.id AS doc_id, sum(q.v::DOUBLE * d.v::DOUBLE) AS score
  FROM unit q JOIN unit d ON q.b = d.b AND q.side = 'q' AND d.side = 'd' GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, round(score, 6) AS score
FROM hit QUALIFY rank <= 3
"""
