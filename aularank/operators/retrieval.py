"""Knowledge-tree index, routing, chunk search and context assembly.

TRE-1/2, VEC-1, VEC-3..9, AGG-14, AGG-16.  Queries are a DataFrame; every
step is a join, window or aggregate over it, so routing and search run for all
queries at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aularank.fixed_values import (
    HELP_NO_RESULTS,
    NODE_TEXT_KEYWORDS,
    NODE_TEXT_QUESTIONS,
    PASSAGE_PREFIX,
    PROMPT_BASE,
    PROMPT_ROUTER,
    PROMPT_SIFODS,
    QUERY_PREFIX,
    ROUTE_METHOD_FAST,
    ROUTE_METHOD_LLM,
    ROUTE_METHOD_NO_INDEX,
    ROUTE_REASON_HIGH,
    ROUTE_REASON_LOW,
    ROUTE_REASON_OK,
    ROUTE_REASON_TIE,
    SOURCE_NONE,
)
from aularank.functions.columns import fmt_fixed, round_half_away, token_count
from aularank.operators.vectors import top_k_dot, top_k_dot_cells
from aularank.params import RouterParams
from aularank.session import ensure_checkpoint_dir

# A tree node with its children kept as raw JSON text (expanded level by level).
NODE_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("keywords", T.ArrayType(T.StringType())),
    T.StructField("hypothetical_questions", T.ArrayType(T.StringType())),
    T.StructField("knowledge_base", T.StringType()),
    T.StructField("children", T.ArrayType(T.StringType())),
])


# ---- TRE-1 / TRE-2 / SRC-4 ---------------------------------------------------

def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """SRC-4: one row per tree document (whole file); a missing path -> empty."""
    try:
        return spark.read.text(path, wholetext=True).select(F.col("value").alias("json"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # only a missing tree is an empty index
            raise
        return spark.createDataFrame([], "json string")


def node_text(node: Column | None = None) -> Column:
    """TRE-2: ``"{name}. {description}. Palabras clave: {kw}."`` + optional questions."""
    kw = F.array_join(F.coalesce(F.col("keywords"), F.array().cast("array<string>")), ", ")
    q = F.coalesce(F.col("hypothetical_questions"), F.array().cast("array<string>"))
    base = F.concat(F.col("name"), F.lit(". "), F.col("description"), F.lit(". "),
                    F.lit(NODE_TEXT_KEYWORDS), kw, F.lit("."))
    return F.when(F.size(q) > 0, F.concat(base, F.lit(NODE_TEXT_QUESTIONS), F.array_join(q, " | "))) \
        .otherwise(base)


def flatten_tree(trees: DataFrame) -> DataFrame:
    """TRE-1: preorder nodes of ``root.children[0]`` that have a knowledge base.

    Output: ``(knowledge_base, name, description, keywords, path, embed_text,
    ord)``; ``ord`` is the position path, so ordering by it is preorder.
    Expanded one tree level per step until a level is empty, whatever the depth.  A level is checkpointed, so the
    next one is read from it and nothing is parsed again from the root.
    """
    ensure_checkpoint_dir(trees.sparkSession)
    root = trees.select(F.from_json("json", NODE_SCHEMA).alias("n"))
    level = root.select(
        F.from_json(F.col("n.children")[0], NODE_SCHEMA).alias("n"),
        F.array().cast("array<string>").alias("parents"),
        F.array(F.lit(0)).alias("ord"),
    ).where(F.col("n").isNotNull()).checkpoint()
    out = None
    while out is None or not level.isEmpty():
        cur = level.select(
            "n", F.concat("parents", F.array(F.col("n.name"))).alias("names"), "ord")
        emitted = cur.where(F.col("n.knowledge_base").isNotNull() & (F.col("n.knowledge_base") != "")).select(
            F.col("n.knowledge_base").alias("knowledge_base"), F.col("n.name").alias("name"),
            F.col("n.description").alias("description"),
            F.coalesce(F.col("n.keywords"), F.array().cast("array<string>")).alias("keywords"),
            F.col("n.hypothetical_questions").alias("hypothetical_questions"),
            F.array_join("names", " > ").alias("path"), "ord")
        out = emitted if out is None else out.unionByName(emitted)
        level = cur.select(F.posexplode(F.coalesce(F.col("n.children"), F.array().cast("array<string>")))
                           .alias("i", "child"), "names", "ord").select(
            F.from_json("child", NODE_SCHEMA).alias("n"), F.col("names").alias("parents"),
            F.concat("ord", F.array("i")).alias("ord")).checkpoint()
    return out.withColumn("embed_text", node_text()).drop("hypothetical_questions")


# ---- VEC-1: encoder hook -------------------------------------------------------

#: Words of the built-in encoder: runs of letters and digits.
WORD_PATTERN = r"[\p{L}\p{N}]+"


def _counting(dim: int) -> list:
    """Stages from ``_t`` (text) to ``_tf``: how often each of ``dim`` buckets is met; a word's bucket follows from its digest alone."""
    from pyspark.ml.feature import CountVectorizerModel, SQLTransformer

    pattern = WORD_PATTERN.replace("\\", "\\\\")
    words = SQLTransformer(statement=(
        f"SELECT *, transform(regexp_extract_all(lower(_t), '{pattern}', 0), "
        f"w -> CAST(CAST(conv(substr(md5(w), 1, 7), 16, 10) AS BIGINT) % {dim} AS STRING)) AS _w FROM __THIS__"))
    return [words, CountVectorizerModel.from_vocabulary([str(b) for b in range(dim)], inputCol="_w", outputCol="_tf")]


def _prefixed(df: DataFrame, text_col: str, prefix: str) -> DataFrame:
    return df.withColumn("_t", F.concat(F.lit(prefix), F.coalesce(F.col(text_col), F.lit(""))))


def fit_encoder(passages: DataFrame, text_col: str, prefix: str = PASSAGE_PREFIX, dim: int = 256):
    """VEC-1: a ``PipelineModel`` with the inverse document frequencies of ``passages`` (null text: empty).

    Fit once on the passages, store it (``plans.publish.publish_encoder``) and pass it to every ``embed``, so that
    passages and queries lie in one space.  It holds ``dim`` weights, however many passages there are; without any passage
    it counts words and weighs nothing.
    """
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.feature import IDF

    if passages.isEmpty():
        return PipelineModel(_counting(dim))
    stages = [*_counting(dim), IDF(inputCol="_tf", outputCol="_idf")]
    return Pipeline(stages=stages).fit(_prefixed(passages.select(text_col), text_col, prefix))


def embed(df: DataFrame, text_col: str, prefix: str = QUERY_PREFIX, encoder=None, dim: int = 256, model=None) -> DataFrame:
    """VEC-1 / UDF-2: add a unit-length ``embedding`` for ``prefix + text`` (``PASSAGE_PREFIX`` for nodes).

    ``encoder``: optional function without arguments that loads a model once per task and returns a callable
    ``pandas.Series[str] -> pandas.Series[list]``; it runs as an iterator pandas UDF.
    ``model``: what ``fit_encoder`` returned: word counts times (1 + inverse document frequency), scaled to unit length.
    With neither, plain word counts in ``dim`` buckets.  Nothing is fitted here: a text has one vector in whatever table it stands.
    """
    if encoder is not None:
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            loaded = encoder()
            for batch in batches:
                yield loaded(batch)

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        text = F.concat(F.lit(prefix), F.coalesce(F.col(text_col), F.lit("")))
        return df.withColumn("embedding", F.pandas_udf(run, T.ArrayType(T.FloatType()))(text))
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import vector_to_array

    out = (PipelineModel(_counting(dim)) if model is None else model).transform(_prefixed(df, text_col, prefix))
    # tf * (1 + idf): a word that every text has still counts, so a text with words is no zero vector.
    both = vector_to_array("_tf")
    if "_idf" in out.columns:
        both = F.zip_with(both, vector_to_array("_idf"), lambda a, b: a + b)
    out = out.withColumn("_v", both)
    out = out.withColumn("_n", F.sqrt(F.aggregate("_v", F.lit(0.0), lambda t, x: t + x * x)))
    unit = F.transform("_v", lambda x: (x / F.when(F.col("_n") > 0, F.col("_n")).otherwise(1.0)).cast("float"))
    return out.withColumn("embedding", unit).drop("_t", "_w", "_tf", "_idf", "_v", "_n")


def node_index(trees: DataFrame, encoder=None, dim: int = 256, model=None) -> DataFrame:
    """TRE-1/2, VEC-1: the tree's nodes with the embedding of their text."""
    return embed(flatten_tree(trees), "embed_text", PASSAGE_PREFIX, encoder, dim, model)


# ---- VEC-3 / VEC-4 / VEC-5: routing ---------------------------------------------

def route_candidates(queries: DataFrame, nodes: DataFrame, p: RouterParams = RouterParams(),
                     node_id: str = "node_vec_id", excluded: DataFrame | None = None) -> DataFrame:
    """VEC-3: top ``p.candidates`` nodes per query (score desc, tree order asc).

    queries: (query_id, embedding); nodes: (knowledge_base, name, path, ord,
    ``node_id``, embedding).  Every node counts; only a caller that made both from one table passes the pairs
    (left_id = query_id, right_id = node id) that must not meet.
    """
    left = queries.select(F.col("query_id").alias("id"), F.lit("").alias("group"), F.col("embedding").alias("vec"))
    right = nodes.select(F.col(node_id).alias("id"), F.lit("").alias("group"), F.col("embedding").alias("vec"))
    hits = top_k_dot(left, right, p.candidates, p.block_rows, excluded)
    return hits.join(nodes.withColumnRenamed(node_id, "right_id"), "right_id").select(
        F.col("left_id").alias("query_id"), "rank", "knowledge_base", "name", "description", "path", "score")


def route_decision(cands: DataFrame, queries: DataFrame, nodes: DataFrame,
                   p: RouterParams = RouterParams()) -> DataFrame:
    """VEC-4/5: decision per query and the selected node.

    fast if s1 >= high; escalate if s1 < low ("score bajo") or s1 - s2 < gap
    ("empate"); else fast ("score ok").  Escalated queries take the external
    label ``llm_kb`` when it names a node of the whole index (exact match after
    trim, Q24), else the best candidate.  ``score`` is always the best
    candidate's, rounded to 4.  A query without candidates (an empty index) goes to the general collection.
    """
    c = cands.groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s1"),
        F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0.0)).alias("s2"),
        F.max(F.when(F.col("rank") == 1, F.struct("knowledge_base", "name", "path"))).alias("best"),
        F.array_sort(F.collect_list(F.struct("rank", "knowledge_base", "score"))).alias("cands"),
    )
    diff = F.col("s1") - F.col("s2")
    fast = (F.col("s1") >= p.high) | ~((F.col("s1") < p.low) | (diff < p.gap))
    s1 = F.col("s1")
    tie = (s1 < p.high) & (s1 >= p.low) & (diff < p.gap)
    opening = lambda reason: F.lit(reason.split("{")[0])
    label = (F.when(s1 >= p.high, opening(ROUTE_REASON_HIGH))
             .when(s1 < p.low, opening(ROUTE_REASON_LOW))
             .when(diff < p.gap, opening(ROUTE_REASON_TIE))
             .otherwise(opening(ROUTE_REASON_OK)))
    # The value the reason shows (s1, or the gap for a tie) is materialised as a
    # column first, so the formatter's expression tree stays small in codegen.
    c = c.withColumn("_shown", F.when(tie, diff).otherwise(s1)).withColumn("_label", label)
    c = c.withColumn("_reason", F.concat(F.col("_label"), fmt_fixed(F.col("_shown"), 4), F.lit(")")))
    reason = F.col("_reason")
    fast_fmt = ROUTE_METHOD_FAST.split("{}")
    llm_fmt = ROUTE_METHOD_LLM.split("{}")
    method = F.when(fast, F.concat(F.lit(fast_fmt[0]), reason, F.lit(fast_fmt[1]))) \
        .otherwise(F.concat(F.lit(llm_fmt[0]), reason, F.lit(llm_fmt[1])))
    lab = nodes.select(F.col("knowledge_base").alias("_lkb"), F.col("name").alias("_lname"),
                       F.col("path").alias("_lpath")).dropDuplicates(["_lkb"])
    q = queries.select("query_id", F.trim("llm_kb").alias("llm_kb"))
    j = q.join(c, "query_id", "left").join(lab, F.col("llm_kb") == F.col("_lkb"), "left")
    known = F.col("s1").isNotNull()
    use_label = known & ~fast & F.col("_lkb").isNotNull()
    return j.select(
        "query_id",
        F.when(use_label, F.col("_lkb")).when(known, F.col("best.knowledge_base")).otherwise(F.lit(p.general_kb)).alias("kb"),
        F.when(use_label, F.col("_lname")).when(known, F.col("best.name")).otherwise(F.lit("fallback")).alias("node"),
        F.when(use_label, F.col("_lpath")).otherwise(F.col("best.path")).alias("path"),
        F.when(known, method).otherwise(F.lit(ROUTE_METHOD_NO_INDEX)).alias("method"),
        F.when(known, fast).alias("fast_path"),
        round_half_away(F.col("s1"), 4).alias("score"),
        F.transform(F.coalesce("cands", F.array().cast("array<struct<rank:int,knowledge_base:string,score:double>>")), lambda x: F.struct(x["rank"].alias("rank"), x["knowledge_base"].alias("kb"),
                                                round_half_away(x["score"], 4).alias("score"))).alias("candidates"),
    )


def escalation_prompts(cands: DataFrame, decisions: DataFrame, queries: DataFrame) -> DataFrame:
    """VEC-6: router prompt for escalated queries (candidates with score .4f)."""
    line = F.concat(F.lit("- "), F.col("knowledge_base"), F.lit(" | "), F.col("name"), F.lit(" | score: "),
                    fmt_fixed(F.col("score"), 4), F.lit("\n  "), F.col("description"))
    listed = cands.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))),
                                 lambda x: x["l"]), "\n").alias("cands_text"))
    pre, rest = PROMPT_ROUTER.split("{query}")
    mid, post = rest.split("{candidates}")
    esc = decisions.where(~F.col("fast_path")).select("query_id")
    return esc.join(listed, "query_id").join(queries.select("query_id", "text"), "query_id").select(
        "query_id", F.concat(F.lit(pre), F.col("text"), F.lit(mid), F.col("cands_text"), F.lit(post)).alias("prompt"))


# ---- VEC-7 / VEC-8: chunk search -------------------------------------------------

def search_chunks(routed: DataFrame, queries: DataFrame, chunks: DataFrame, p: RouterParams = RouterParams(),
                  excluded: DataFrame | None = None) -> DataFrame:
    """VEC-7/8: top ``p.chunk_top_k`` chunks of the routed collection per query;
    a query whose collection has no chunk for it is searched in the general collection.  Payload defaults: text "",
    filename "", chunk 0 (SRC-5).  Scores rounded to 4 (router path).

    One search serves both: a collection without chunks is known from a count, before any product.  ``excluded``:
    pairs (left_id = query_id, right_id = chunk_id) that must not meet.
    """
    q = routed.select("query_id", "kb").join(queries.select("query_id", "embedding"), "query_id")
    ch = chunks.select(F.col("chunk_id").alias("id"), F.col("kb").alias("group"), F.col("embedding").alias("vec"))
    held = chunks.groupBy("kb").agg(F.count(F.lit(1)).alias("_n"))
    q = q.join(held, "kb", "left")
    gone = F.lit(0)
    if excluded is not None:
        out = excluded.distinct().join(chunks.select(F.col("chunk_id").alias("right_id"), "kb"), "right_id")
        out = out.groupBy(F.col("left_id").alias("query_id"), "kb").agg(F.count(F.lit(1)).alias("_x"))
        q = q.join(out, ["query_id", "kb"], "left")
        gone = F.coalesce("_x", F.lit(0))
    target = F.when(F.coalesce("_n", F.lit(0)) > gone, F.col("kb")).otherwise(F.lit(p.general_kb))
    left = q.select(F.col("query_id").alias("id"), target.alias("group"), F.col("embedding").alias("vec"))
    hits = top_k_dot_cells(left, ch, p.chunk_top_k, p.cells, p.block_rows, excluded) if p.cells else \
        top_k_dot(left, ch, p.chunk_top_k, p.block_rows, excluded)
    payload = chunks.select(F.col("chunk_id").alias("right_id"), "kb",
                            F.coalesce("text", F.lit("")).alias("text"),
                            F.coalesce("filename", F.lit("")).alias("filename"),
                            F.coalesce("chunk", F.lit(0)).alias("chunk"))
    return hits.join(payload, "right_id").select(
        F.col("left_id").alias("query_id"), "rank", "kb", "filename", "chunk", "text",
        round_half_away(F.col("score"), 4).alias("score"))


def search_general(queries: DataFrame, chunks: DataFrame, p: RouterParams = RouterParams()) -> DataFrame:
    """VEC-9 without a router: every query searches the general collection."""
    return search_chunks(queries.select("query_id", F.lit(p.general_kb).alias("kb")), queries, chunks, p)


# ---- AGG-14 / AGG-16 / VEC-9 ------------------------------------------------------

def context_text(hits: DataFrame) -> DataFrame:
    """AGG-14: ``"[filename]\\ntext\\n"`` pieces in rank order joined by a blank line."""
    piece = F.concat(F.lit("["), F.col("filename"), F.lit("]\n"), F.col("text"), F.lit("\n"))
    return hits.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", piece.alias("p")))),
                                 lambda x: x["p"]), "\n\n").alias("context"),
        F.count(F.lit(1)).alias("n_chunks"),
        F.transform(F.slice(F.array_sort(F.collect_list(F.struct("rank", "filename", "score"))), 1, 3),
                    lambda x: F.struct(x["filename"].alias("fuente"), x["score"].alias("relevancia")))
        .alias("referencias"),
    )


def answer_prompts(queries: DataFrame, routed: DataFrame | None, hits: DataFrame, counter=None) -> DataFrame:
    """VEC-9: prompt, references, token count and provenance per query.

    No chunks -> fixed help text, source ``ninguna``, no references.  Without a router (``routed`` None) the
    answer's node is ``general`` and its source names no collection.
    """
    ctx = context_text(hits)
    pre, rest = PROMPT_BASE.split("{context}")
    mid, post = rest.split("{question}")
    asked = queries.select("query_id", "text")
    if routed is None:
        source, node = F.lit("qdrant"), F.lit("general")
    else:
        asked = asked.join(routed.select("query_id", "kb", "node"), "query_id", "left")
        source = F.concat(F.lit("qdrant:"), F.col("kb"))
        node = F.concat(F.col("node"), F.lit(" ("), F.col("kb"), F.lit(")"))
    j = asked.join(ctx, "query_id", "left")
    has = F.col("n_chunks").isNotNull()
    prompt = F.concat(F.lit(pre), F.col("context"), F.lit(mid), F.col("text"), F.lit(post),
                      F.lit("\n\n"), F.lit(PROMPT_SIFODS))
    return j.select(
        "query_id",
        F.when(has, prompt).alias("prompt"),
        F.when(~has, F.lit(HELP_NO_RESULTS)).alias("respuesta_fija"),
        F.when(has, source).otherwise(F.lit(SOURCE_NONE)).alias("fuente_datos"),
        F.when(has, node).alias("nodo_navegacion"),
        F.coalesce(F.col("referencias"), F.array().cast("array<struct<fuente:string,relevancia:double>>"))
        .alias("referencias"),
        F.when(has, token_count(prompt, counter)).alias("tokens_entrada"),
    )
