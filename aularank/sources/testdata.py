"""Adapters that derive the recommender / retrieval / log inputs from the
driver's parquet tables (FIXTURES.md part B).

Every derived table is a DataFrame expression over the given tables, so its
size grows with the scale factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_enrolments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIXTURES B1: one enrolment per lineitem row.

    lineitem and orders are the two big sides (sort-merge on the order key);
    customer/part joins shuffle on their keys unless AQE sees a small side;
    nation and region are fixed-size TPC-H dimension tables (25 / 5 rows).
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    na = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    re = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    pa = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    geo = na.join(re, na.n_regionkey == re.r_regionkey)
    j = (
        li.join(od, li.l_orderkey == od.o_orderkey)
        .join(cu, F.col("o_custkey") == cu.c_custkey)
        .join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(pa, F.col("l_partkey") == pa.p_partkey)
    )
    audience = (
        F.when(F.col("p_type") == "PROMO", "TODOS")
        .when(F.col("p_type") == "ECONOMY", "BUILDING, HOUSEHOLD")
        .when(F.col("p_type") == "MEDIUM", "MACHINERY")
        .when(F.col("p_type") == "STANDARD", "AUTOMOBILE")
        .when(F.col("p_type") == "SMALL", "FURNITURE")
        .otherwise("")
    )
    # Attributes that vary with the source order within a course or a user, some of them null.
    line, order = F.col("l_linenumber"), F.col("l_orderkey")
    return j.select(
        (order * 10 + line).cast("long").alias("ORD"),
        (F.year("o_orderdate") - F.col("p_partkey") % 4).alias("AÑO"),
        F.col("o_orderpriority").alias("TIPO_CONSTANCIA"),
        F.concat(F.col("p_name"), F.lit(" "), F.col("p_partkey").cast("string"),
                 F.when(line % 3 == 0, " (rev)").otherwise("")).alias("CURSO"),
        F.when(order % 11 != 0, F.col("n_name")).alias("NOMBRE_DRE"),
        F.col("r_name").alias("NOMBRE_UGEL"),
        F.col("o_custkey").cast("string").alias("USUARIO_DOCUMENTO"),
        F.col("c_name").alias("NOMBRE_COMPLETO"),
        F.when(order % 9 != 0, F.col("c_mktsegment")).alias("NIVELNEXUS"),
        F.when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("APROBACION"),
        F.col("l_partkey").cast("string").alias("ID_OFERTA_FORMATIVA"),
        F.col("l_suppkey").cast("string").alias("ID_GRUPO"),
        F.lit(None).cast("string").alias("FECHA_NACIMIENTO"),
        (F.col("p_size") % 2).alias("ES_FOCALIZADO"),
        (F.col("p_size") + line % 2).alias("HORAS_PROGRAMA"),
        (F.col("l_quantity") / 10).alias("CALIFICACIONES"),
        F.when(line % 4 != 1, F.concat(F.col("p_brand"), F.lit(" "), F.col("p_type"))).alias("PROPOSITO"),
        F.when(F.col("p_size") % 5 != 0, 1).otherwise(0).alias("ACTIVO"),
        F.when(line % 5 != 2, audience).alias("PUBLICO_OBJETIVO"),
        F.when(F.col("l_returnflag") == "R", "SI").when(F.col("l_returnflag") == "N", "NO").alias("CURSO_CULMINADO"),
        (F.lit(25) + F.col("o_custkey") % 40).alias("EDAD"),
        (F.col("l_discount") * 10).alias("PORCENTAJE_AVANCE"),
    )


def enrolments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aularank.sources.enrolments import clean_enrolments

    return clean_enrolments(raw_enrolments(spark, sf_dir))


# ---- logs (FIXTURES B3) -----------------------------------------------------

def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    is_rec = F.col("event_type").isin("purchase", "signup")
    err = F.col("event_type") == "error"
    k = F.get_json_object("props", "$.k").cast("int")
    return ev.select(
        F.col("event_id").cast("long").alias("id"),
        F.col("user_id").cast("string").alias("usuario"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("nombre_usuario"),
        F.concat(F.lit("mensaje "), F.col("event_id").cast("string")).alias("mensaje"),
        F.concat(F.lit("respuesta "), F.col("event_id").cast("string")).alias("respuesta"),
        F.when(is_rec, "recomendacion").otherwise("sifods").alias("tarea"),
        F.when(is_rec, "modelo_recomendacion_hibrido").otherwise("qdrant").alias("fuente_datos"),
        F.when(~err, k).alias("tokens_entrada"),
        F.when(~err, 2 * k).alias("tokens_salida"),
        F.when(~err, F.floor(F.col("value") * 10).cast("int")).alias("latencia_ms"),
        F.col("ts").alias("timestamp"),
    )


def recommendation_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three detail rows per recommendation event (positions 1..3)."""
    ev = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "signup"))
    rows = ev.select(
        "event_id", "user_id", "ts", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("posicion"))
    course = ((F.col("event_id") * F.col("posicion")) % 200).cast("string")
    return rows.select(
        (F.col("event_id") * 10 + F.col("posicion")).cast("long").alias("id"),
        F.col("event_id").cast("long").alias("conversacion_id"),
        F.col("user_id").cast("string").alias("usuario"),
        F.col("posicion").cast("smallint").alias("posicion"),
        course.alias("id_oferta_formativa"),
        F.concat(F.lit("curso "), course).alias("curso"),
        (F.col("posicion") * 10).cast("int").alias("horas_programa"),
        F.lit("TODOS").alias("publico_objetivo"),
        F.lit(0.5).cast("decimal(4,2)").alias("tasa_culminacion"),
        F.lit(0.25).cast("decimal(4,2)").alias("tasa_aprobacion"),
        F.lit(3.5).cast("decimal(3,1)").alias("calificacion_prom"),
        (F.lit(1.0) / F.col("posicion")).cast("decimal(6,4)").alias("score_final"),
        F.lit(0).cast("decimal(6,4)").alias("score_colaborativo"),
        F.lit(0).cast("decimal(6,4)").alias("score_popularidad"),
        F.lit(0).cast("decimal(6,4)").alias("score_historial"),
        F.lit(0).cast("decimal(6,4)").alias("score_novedad"),
        F.array(F.lit("popularidad"), F.lit("novedad")).alias("algoritmos_usados"),
        F.concat(F.lit("justificacion "), course).alias("justificacion"),
        F.col("ts").alias("timestamp"),
    )


def text_enrolments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as a flat text export: alias headers, every value a string, some of them not numbers."""
    raw = raw_enrolments(spark, sf_dir)
    part = F.col("ID_OFERTA_FORMATIVA").cast("long")
    return raw.select(
        F.col("ORD").cast("string").alias("ord"),
        F.concat(F.lit(" "), F.col("AÑO").cast("string"), F.lit(" ")).alias(" anio "),
        F.col("USUARIO_DOCUMENTO").alias("dni"),
        F.concat(F.lit(" "), F.col("ID_OFERTA_FORMATIVA"), F.lit(" ")).alias("Id_Oferta"),
        F.col("CURSO").alias("curso"),
        F.col("NIVELNEXUS").alias("Nivel"),
        F.when(F.col("APROBACION") == 1, "1.0").otherwise("-").alias("aprobado"),
        F.when(part % 3 == 0, "nan").otherwise(F.col("ACTIVO").cast("string")).alias("ACTIVO"),
        F.when(part % 10 == 0, "n/a").otherwise(F.concat(F.lit(" "), F.col("HORAS_PROGRAMA").cast("string"), F.lit(".5"))).alias("HORAS"),
        F.when(part % 7 == 0, "x").otherwise(F.concat(F.col("CALIFICACIONES").cast("int").cast("string"), F.lit("e0"))).alias("Rating"),
        F.when(F.col("CURSO_CULMINADO") == "SI", " sí ").when(F.col("CURSO_CULMINADO") == "NO", "2").otherwise("no").alias("CULMINADO"),
    )


def dirty_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with violations of every declared rule, at fixed rates of the events."""
    e = F.col("id")
    return interactions(spark, sf_dir).withColumns({
        "usuario": F.when(e % 97 == 0, None).when(e % 61 == 0, F.repeat(F.lit("u"), F.lit(101))).otherwise(F.col("usuario")),
        "mensaje": F.when(e % 101 != 0, F.col("mensaje")),
        "respuesta": F.when(e % 103 != 0, F.col("respuesta")),
        "tarea": F.when(e % 107 == 0, None).when(e % 89 == 0, "otra").when(e % 59 == 0, F.repeat(F.lit("t"), F.lit(21))).otherwise(F.col("tarea")),
        "nombre_usuario": F.when(e % 83 == 0, F.repeat(F.lit("n"), F.lit(201))).otherwise(F.col("nombre_usuario")),
        "fuente_datos": F.when(e % 53 == 0, F.repeat(F.lit("f"), F.lit(51))).otherwise(F.col("fuente_datos")),
        "id": F.when(e % 79 == 0, e - 1).otherwise(e),
    })


def dirty_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail rows with violations of every declared rule."""
    e = F.col("conversacion_id")
    return recommendation_details(spark, sf_dir).withColumns({
        "id": F.when(e % 47 == 0, e * 10).otherwise(F.col("id")),
        "conversacion_id": F.when(e % 71 == 0, -e - 1).when(e % 73 != 0, e),
        "usuario": F.when(e % 43 == 0, None).when(e % 41 == 0, F.repeat(F.lit("u"), F.lit(101))).otherwise(F.col("usuario")),
        "posicion": F.when(e % 67 != 0, F.col("posicion")),
        "id_oferta_formativa": F.when(e % 37 == 0, F.repeat(F.lit("i"), F.lit(51))).otherwise(F.col("id_oferta_formativa")),
        "curso": F.when(e % 31 == 0, F.repeat(F.lit("c"), F.lit(256))).otherwise(F.col("curso")),
        "publico_objetivo": F.when(e % 29 == 0, F.repeat(F.lit("p"), F.lit(201))).otherwise(F.col("publico_objetivo")),
    })


# ---- vectors (FIXTURES B2) --------------------------------------------------

def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk collection: every embedding, left-joined to its document text."""
    em = table(spark, sf_dir, "embeddings")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return em.join(docs, em.vec_id == docs.doc_id, "left").select(
        F.concat(F.lit("kb_"), F.col("label").cast("string")).alias("kb"),
        F.col("vec_id").alias("chunk_id"),
        F.col("source").alias("filename"),
        F.col("vec_id").cast("long").alias("chunk"),
        F.col("text"),
        F.col("embedding"),
    )


def chunks_with_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third label's chunks are in the general collection, so its own collection is empty."""
    label = F.regexp_extract("kb", "([0-9]+)$", 1).cast("int")
    return chunks(spark, sf_dir).withColumn("kb", F.when(label % 3 == 0, "general").otherwise(F.col("kb")))


def tree_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One knowledge tree for every fifty document ids: its root's first child holds a node for each document.

    Ids that are a multiple of three have no knowledge base; even ones have a question.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    number = F.col("doc_id").cast("string")
    node = F.struct(
        F.concat(F.lit("Doc "), number).alias("name"),
        F.concat(F.lit("Fuente "), F.col("source")).alias("description"),
        F.array("lang", "source").alias("keywords"),
        F.when(F.col("doc_id") % 2 == 0, F.array(F.concat(F.lit("q"), number), F.lit("r"))).alias("hypothetical_questions"),
        F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("kb_"), number)).alias("knowledge_base"),
    )
    trees = docs.groupBy(F.floor(F.col("doc_id") / 50).alias("tree")).agg(
        F.array_sort(F.collect_list(F.struct("doc_id", node.alias("n")))).alias("ns"))
    inner = F.to_json(F.struct(F.lit("Tema").alias("name"), F.lit("t").alias("description"), F.array(F.lit("k")).alias("keywords"),
                               F.transform("ns", lambda x: x["n"]).alias("children")))
    return trees.select(F.concat(F.lit('{"name": "Raiz", "children": ['), inner, F.lit("]}")).alias("json"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routing index: one node per label, the vector with the smallest id."""
    em = table(spark, sf_dir, "embeddings")
    g = em.groupBy("label").agg(
        F.min("vec_id").alias("node_vec_id"),
        F.min_by("embedding", "vec_id").alias("embedding"),
    )
    kb = F.concat(F.lit("kb_"), F.col("label").cast("string"))
    name = F.concat(F.lit("Nodo "), F.col("label").cast("string"))
    return g.select(
        kb.alias("knowledge_base"),
        name.alias("name"),
        F.concat(F.lit("Tema "), F.col("label").cast("string")).alias("description"),
        F.concat(F.lit("Raiz > "), name).alias("path"),
        F.array(F.col("label").cast("int")).alias("ord"),
        "node_vec_id",
        "embedding",
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding is a query; its document text is the question."""
    em = table(spark, sf_dir, "embeddings")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return em.join(docs, em.vec_id == docs.doc_id, "left").select(
        F.col("vec_id").alias("query_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.col("embedding"),
        F.lit(None).cast("string").alias("llm_kb"),
    )


def labelled_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries with an outside label, some of them unknown, padded by blanks."""
    label = F.concat(F.lit(" kb_"), (F.col("query_id") % 40).cast("string"), F.lit(" "))
    return queries(spark, sf_dir).withColumn("llm_kb", label)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-6 requests: every customer asks for a number of courses of their own (null, zero and negative: default)."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.cast("string").alias("USUARIO_DOCUMENTO"),
        F.when(key % 7 != 0, (key % 7 - 2).cast("int")).alias("top_k"))
