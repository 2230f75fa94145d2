"""Verdict policies (P1-P7) and redaction.

Row path (every matcher is a row matcher): each text's hit arrays are combined
inside the same projection that matched them. A verdict then costs one scan and
one projection: no shuffle, no join back to the texts, clean texts stay in place,
and a text with a huge number of hits is still one row in one task.

Table path: hits that arrive as a table (banks beyond a literal, user matchers) come back to their
text by a row number, so texts may share an id; a chain runs each matcher only on the rows still
without hits. ``moderate_hits`` decides from a HITS table alone: only ids and counts are
shuffled there, with partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tamis import fixed, schemas
from tamis.functions.arrays import running_max, let
from tamis.functions.text import weight_micros
from tamis.operators.grams import HashTable, pieces
from tamis.operators.matchers import empty_hits, _weight_of
from tamis.functions.sqlutil import literal_rows
from tamis.session import materialize

MODES = ("chain", "parallel", "weighted")
#: Characters masked at a time.
MASK_PIECE = 4096


def _mode(mode: str) -> str:
    return mode if mode in ("parallel", "weighted") else "chain"


def _size0(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0))


def _resolve(matchers) -> list:
    """Matchers as given; a bank (DataFrame or rows) means the default keyword matcher,
    and a name is looked up in the registry ("matcher not found" otherwise)."""
    from tamis.operators.keyword import KeywordMatcher
    from tamis.operators.matchers import Matcher
    from tamis.operators.registry import get_matcher
    if isinstance(matchers, DataFrame):
        return [KeywordMatcher(matchers)]
    if isinstance(matchers, (str, Matcher)):
        matchers = [matchers]
    matchers = list(matchers)
    if matchers and isinstance(matchers[0], (tuple, dict)):
        return [KeywordMatcher(matchers)]
    return [get_matcher(m) if isinstance(m, str) else m for m in matchers]


def reference_order(hits: Column) -> Column:
    """Hits by end position, longest first at the same end, matcher order first."""
    keyed = F.transform(hits, lambda h: F.struct(h["matcher_ord"].alias("o"), (h["idx"] + h["len"]).alias("e"),
                                                 (-h["len"]).alias("nl"), h["word"].alias("w"), h.alias("h")))
    return F.transform(F.sort_array(keyed), lambda x: x["h"])


def moderate(texts: DataFrame, matchers: list, mode: str = fixed.DEFAULT_MODE,
             threshold: float = fixed.DEFAULT_THRESHOLD, fallback: str = fixed.DEFAULT_FALLBACK,
             weights: dict | None = None, id_col: str = "id", text_col: str = "text",
             keep: tuple = ()) -> DataFrame:
    """P4: dispatch to chain / parallel / weighted; an unknown mode is chain.

    ``matchers``: matcher objects, registered matcher names, or a bank (the default
    keyword matcher). Result: (id, flagged, action, score, hits, n_hits[, keep...]);
    ``score`` is set in weighted mode only, ``hits`` is empty in weighted mode. Ids need not be
    unique. A row whose text is NULL cannot be
    moderated: flagged=false, action=fallback.
    """
    mode = _mode(mode)
    fb = fixed.ACTION_BLOCK if fallback == fixed.ACTION_BLOCK else fixed.ACTION_PASS
    matchers = _resolve(matchers)
    if not all(getattr(m, "row_based", False) for m in matchers):
        return _moderate_tables(texts, matchers, mode, threshold, fb, weights, id_col, text_col, keep)
    t = F.col("_t")
    df = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("_t"), *keep)
    score = F.lit(None).cast("double")
    if mode == "chain":
        # matcher k runs only when matchers 0..k-1 found nothing (the reference stops there too)
        nothing_yet = None
        for k, m in enumerate(matchers):
            h = m.hits(t, k)
            df = df.withColumn(f"_h{k}", h if nothing_yet is None else F.when(nothing_yet, h))
            e = _size0(F.col(f"_h{k}")) == 0
            nothing_yet = e if nothing_yet is None else (nothing_yet & e)
        chosen = None
        for k in range(len(matchers)):
            c = F.col(f"_h{k}")
            chosen = F.when(_size0(c) > 0, c) if chosen is None else chosen.when(_size0(c) > 0, c)
        hits = empty_hits() if chosen is None else chosen.otherwise(empty_hits())
        df = df.withColumn("_hits", reference_order(hits))
    elif mode == "parallel":
        # each matcher's first hit per word; the lowest matcher order keeps a word
        allh = F.concat(*[m.first_hits(t, k) for k, m in enumerate(matchers)]) if matchers else empty_hits()
        df = df.withColumn("_srt", F.sort_array(F.transform(
            allh, lambda h: F.struct(h["word"].alias("k"), h["matcher_ord"].alias("o"), h["idx"].alias("i"),
                                     h["len"].alias("l"), h.alias("h")))))
        s = F.col("_srt")
        dedup = F.transform(F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["k"] != x["k"])),
                            lambda x: x["h"])
        df = df.withColumn("_hits", reference_order(dedup))
    else:
        total = None
        for m in matchers:
            sm = m.score_micros(t, weights)
            total = sm if total is None else total + sm
        total = F.lit(0).cast("long") if total is None else total
        df = df.withColumn("_score", total).withColumn("_hits", empty_hits())
        score = F.col("_score") / F.lit(1_000_000.0)
    thr = int(round(float(threshold) * 1_000_000))
    if mode == "weighted":
        flagged = F.col("_score") > F.lit(thr)
    else:
        flagged = F.size("_hits") > 0
    out = df.select(
        "id",
        F.when(t.isNull(), F.lit(False)).otherwise(flagged).alias("flagged"),
        F.when(t.isNull(), F.lit(fb)).when(flagged, F.lit(fixed.ACTION_BLOCK))
        .otherwise(F.lit(fixed.ACTION_PASS)).alias("action"),
        F.when(t.isNull(), F.lit(None).cast("double")).otherwise(score).alias("score"),
        F.when(t.isNull(), empty_hits()).otherwise(F.col("_hits")).alias("hits"),
        F.when(t.isNull(), F.lit(0)).otherwise(F.size("_hits")).cast("long").alias("n_hits"),
        *keep)
    return out


# --------------------------------------------------------------------------- flat path

def policy_hits(hits: DataFrame, mode: str = fixed.DEFAULT_MODE) -> DataFrame:
    """The hits a policy returns, from a flat HITS table (aggregations only)."""
    mode = _mode(mode)
    if mode == "weighted":
        return hits.limit(0)
    if mode == "chain":
        first = hits.groupBy("id").agg(F.min("matcher_ord").alias("_first"))
        return (hits.join(first, "id")
                .filter(F.col("matcher_ord") == F.col("_first")).drop("_first"))
    # parallel: per (id, word) the lowest (matcher_ord, idx, len); partial aggregation
    best = hits.groupBy("id", "word").agg(
        F.min(F.struct("matcher_ord", "idx", "len", "matcher", "type", "severity")).alias("b"))
    return best.select("id", "b.matcher", "b.matcher_ord", "word", "b.type", "b.severity", "b.idx", "b.len")


def _moderate_tables(texts: DataFrame, matchers: list, mode: str, threshold: float, fallback: str, weights: dict | None,
                     id_col: str, text_col: str, keep: tuple) -> DataFrame:
    """``moderate`` where some matcher gives its hits as a table.

    Rows are numbered and written once, so that hits come back to their row whatever the ids are. In a chain,
    matcher k sees only the rows that the matchers before it found nothing in (an anti join on the row
    number). Each matcher's hits are written before they are used twice.
    """
    spark = texts.sparkSession
    if texts.isStreaming:
        raise ValueError("a matcher gives a HITS table: moderate the stream batch by batch (moderate_stream_reload)")
    cols = [F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[F.col(k).alias(f"_keep{i}") for i, k in enumerate(keep)]]
    rows = materialize(spark, texts.select(F.monotonically_increasing_id().alias("_row"), *cols), "texts")
    left = rows.where(F.col("_text").isNotNull()).select("_row", "_text")
    hits = None
    for k, m in enumerate(matchers):
        found = materialize(spark, m.flat_hits(left, k, id_col="_row", text_col="_text"), "hits")
        hits = found if hits is None else hits.unionByName(found)
        if mode == "chain":
            left = left.join(found.select(F.col("id").alias("_row")).distinct(), "_row", "left_anti")
    if hits is None:
        hits = spark.createDataFrame([], schemas.HITS)
    chosen = hits if mode == "chain" else policy_hits(hits, mode)
    ids = rows.select(F.col("_row").alias("id"), F.col("_text").isNull().alias("_null"), "_id", *[f"_keep{i}" for i in range(len(keep))])
    r = _decided(ids, _weighed(hits, weights) if mode == "weighted" else _counted(chosen, whole=True), mode, threshold, fallback)
    return r.select(F.col("_id").alias("id"), "flagged", "action", "score", reference_order(F.coalesce(F.col("_hits"), empty_hits())).alias("hits"), "n_hits",
                    *[F.col(f"_keep{i}").alias(k) for i, k in enumerate(keep)])


def _weighed(hits: DataFrame, weights: dict | None) -> DataFrame:
    return hits.groupBy("id").agg(F.sum(_weight_of(F.col("severity"), weight_micros(weights))).alias("_s"), F.lit(0).cast("long").alias("_n"),
                                  empty_hits().alias("_hits"))


def _counted(chosen: DataFrame, whole: bool = False) -> DataFrame:
    """Per text the number of its hits and, if asked, the hits."""
    fields = ("matcher_ord", "matcher", "word", "type", "severity", "idx", "len")
    own = F.collect_list(F.struct(*fields)) if whole else empty_hits()
    return chosen.groupBy("id").agg(F.lit(None).cast("long").alias("_s"), F.count(F.lit(1)).alias("_n"), own.alias("_hits"))


def _decided(ids: DataFrame, per_id: DataFrame, mode: str, threshold: float, fallback: str) -> DataFrame:
    """``ids`` (id, _null, ...) with flagged, action, score, n_hits and _hits from the numbers of each id."""
    j = ids.join(per_id, "id", "left")
    n = F.coalesce(F.col("_n"), F.lit(0).cast("long"))
    if mode == "weighted":
        s = F.coalesce(F.col("_s"), F.lit(0).cast("long"))
        flagged, score = s > F.lit(int(round(float(threshold) * 1_000_000))), s / F.lit(1_000_000.0)
    else:
        flagged, score = n > 0, F.lit(None).cast("double")
    nul = F.col("_null")
    return j.withColumns({
        "flagged": F.when(nul, False).otherwise(flagged),
        "action": F.when(nul, F.lit(fallback)).when(flagged, F.lit(fixed.ACTION_BLOCK)).otherwise(F.lit(fixed.ACTION_PASS)),
        "score": F.when(nul, F.lit(None).cast("double")).otherwise(score),
        "n_hits": F.when(nul, F.lit(0).cast("long")).otherwise(n)})


def moderate_hits(texts: DataFrame, hits: DataFrame, mode: str = fixed.DEFAULT_MODE,
                  threshold: float = fixed.DEFAULT_THRESHOLD, fallback: str = fixed.DEFAULT_FALLBACK,
                  weights: dict | None = None, id_col: str = "id", text_col: str = "text",
                  keep: tuple = ()) -> DataFrame:
    """Verdicts from a flat HITS table: (id, flagged, action, score, n_hits[, keep]).

    Only ids (and ``keep`` columns) cross the shuffle: the text itself is reduced to
    an is-null flag before the join. Ids must name one text here, as the hits know no other.
    """
    mode = _mode(mode)
    fb = fixed.ACTION_BLOCK if fallback == fixed.ACTION_BLOCK else fixed.ACTION_PASS
    ids = texts.select(F.col(id_col).alias("id"), F.col(text_col).isNull().alias("_null"), *keep)
    per_id = _weighed(hits, weights) if mode == "weighted" else _counted(policy_hits(hits, mode))
    return _decided(ids, per_id, mode, threshold, fb).select("id", "flagged", "action", "score", "n_hits", *keep)


# --------------------------------------------------------------------------- P5 / P6

def redact(text: Column, hits: Column) -> Column:
    """P5: struct<text, n_masked, n_islands>; every hit span masked with '*', overlapping
    and touching spans merged, zero-length hits ignored. Offsets are characters.

    Works inside the row: spans sorted by start, a span opens a new island when it
    starts after every earlier span's end (running max), and the masked text is
    rebuilt piece by piece from the slices between islands.
    """
    spans = F.sort_array(F.transform(F.filter(hits, lambda h: h["len"] > 0),
                                     lambda h: F.struct(h["idx"].alias("s"), (h["idx"] + h["len"]).alias("e"))))
    return let(spans, lambda sp: F.when(F.size(sp) == 0, F.struct(
        text.alias("text"), F.lit(0).alias("n_masked"), F.lit(0).alias("n_islands")))
        .otherwise(let(running_max(F.transform(sp, lambda x: x["e"]), inclusive=False),
                       lambda pm: _islands(text, sp, pm))))


def _islands(text: Column, sp: Column, pm: Column) -> Column:
    firsts = F.filter(F.transform(sp, lambda x, i: F.struct(x["s"].alias("s"), F.get(pm, i).alias("pm"),
                                                            (x["s"] > F.get(pm, i)).alias("new"))),
                      lambda z: z["new"])
    maxend = F.array_max(F.transform(sp, lambda x: x["e"]))

    def with_firsts(fs):
        nf = F.size(fs)
        islands = F.transform(fs, lambda f, j: F.struct(
            f["s"].alias("s"), F.when(j < nf - 1, F.get(fs, j + 1)["pm"]).otherwise(maxend).alias("e")))
        return let(islands, lambda isl: _mask_islands(text, isl))

    return let(firsts, with_firsts)


def _mask_islands(text: Column, isl: Column) -> Column:
    n_masked = F.aggregate(isl, F.lit(0), lambda a, iv: a + iv["e"] - iv["s"])

    def masked(p):
        here = F.filter(isl, lambda iv: (iv["e"] > p["off"]) & (iv["s"] < p["off"] + p["n"]))
        return let(here, lambda h: _mask_piece(p["ext"], p["n"], F.transform(h, lambda iv: F.struct((iv["s"] - p["off"]).alias("s"), (iv["e"] - p["off"]).alias("e")))))

    whole = F.array_join(F.transform(pieces(text, MASK_PIECE, 1), masked), "")
    return F.struct(whole.alias("text"), n_masked.alias("n_masked"), F.size(isl).alias("n_islands"))


def _mask_piece(piece: Column, n: Column, isl: Column) -> Column:
    """A piece of ``n`` characters with the islands (sorted, apart; they may reach over its borders) masked, from
    slices between them: positions are counted from the piece's own start only."""
    start, end = lambda iv: F.greatest(iv["s"], F.lit(0)), lambda iv: F.least(iv["e"], n)

    def parts(h):
        def part(iv, j):
            prev = F.when(j == 0, F.lit(0)).otherwise(end(F.get(h, j - 1)))
            return F.concat(F.substr(piece, prev + 1, start(iv) - prev), F.repeat(F.lit("*"), end(iv) - start(iv)))
        tail = end(F.get(h, F.size(h) - 1))
        return F.concat(F.array_join(F.transform(h, part), ""), F.substr(piece, tail + 1, n - tail))

    return let(isl, lambda h: F.when(F.size(h) == 0, piece).otherwise(parts(h)))


def redact_hits(texts: DataFrame, hits: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """P5 from a flat HITS table: (id, text_masked, n_masked, n_islands) of every text (ids must name one text).

    Spans are cut at the borders of pieces of ``MASK_PIECE`` characters; islands are found by a window inside
    each (id, piece), so the hits of a very long text are many groups, and pieces are masked on their own.
    Only a text's masked pieces come together, as its redacted text is one value.
    """
    size = F.lit(MASK_PIECE)
    cut = texts.select(F.col(id_col).alias("id"), F.inline_outer(pieces(F.col(text_col), MASK_PIECE, 1)))
    cut = cut.select("id", F.coalesce(F.expr(f"off div {MASK_PIECE}"), F.lit(0)).cast("long").alias("k"), "n", "ext")
    spans = hits.where("len > 0").select("id", F.col("idx").cast("long").alias("s"), (F.col("idx") + F.col("len")).cast("long").alias("e"))
    spans = spans.select("id", "s", "e", F.explode(F.sequence(F.expr(f"s div {MASK_PIECE}"), F.expr(f"(e - 1) div {MASK_PIECE}"))).alias("k"))
    spans = spans.select("id", "k", F.greatest(F.col("s") - F.col("k") * size, F.lit(0)).cast("int").alias("s"), F.least(F.col("e") - F.col("k") * size, size).cast("int").alias("e")).distinct()
    w = Window.partitionBy("id", "k").orderBy("s", "e")
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", (before.isNull() | (F.col("s") > before)).cast("int")).withColumn("island", F.sum("new").over(w))
    islands = marked.groupBy("id", "k", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    islands = islands.groupBy("id", "k").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("isl"))  # at most MASK_PIECE / 2
    done = cut.join(islands, ["id", "k"], "left").withColumn("isl", F.coalesce("isl", F.expr("cast(array() as array<struct<s:int,e:int>>)")))
    length = F.aggregate("isl", F.lit(0), lambda a, iv: a + F.least(iv["e"], F.col("n")) - iv["s"])
    last = F.get("isl", F.size("isl") - 1)["e"]
    done = done.select("id", F.struct("k", _mask_piece(F.col("ext"), F.col("n"), F.col("isl")).alias("t"), F.coalesce(length, F.lit(0)).alias("m"), F.size("isl").alias("c"),
                                      F.coalesce(F.get("isl", 0)["s"] == 0, F.lit(False)).alias("opens"), F.coalesce(last >= F.col("n"), F.lit(False)).alias("closes")).alias("p"))
    whole = done.groupBy("id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    joined = F.transform("p", lambda x, i: x["c"] - F.when((i > 0) & x["opens"] & F.get("p", i - 1)["closes"], 1).otherwise(0))  # one island over a border
    text = F.when(F.get("p", 0)["t"].isNotNull(), F.array_join(F.transform("p", lambda x: x["t"]), ""))
    return whole.select("id", text.alias("text_masked"), F.aggregate("p", F.lit(0), lambda a, x: a + x["m"]).alias("n_masked"),
                        F.aggregate(joined, F.lit(0), lambda a, x: a + x).alias("n_islands"))


def declared_action(hits: Column, actions: dict) -> Column:
    """P6: the strongest bank action among a text's hits (block > mask > review > pass);
    NULL when there is no hit or no known action."""
    rank = fixed.ACTION_RANK
    words = F.array_distinct(F.transform(hits, lambda h: h["word"]))
    if len(actions) > 64:
        table = HashTable([{"word": w, "r": rank.get(a or "", 0)} for w, a in sorted(actions.items())], [("word", "string"), ("r", "int")])
        best = F.array_max(F.flatten(F.transform(words, lambda w: F.transform(table.found(w), lambda b: b["r"]))))
    else:
        rows = [{"word": w, "r": rank.get(a or "", 0)} for w, a in sorted(actions.items())]
        lit = literal_rows(rows, [("word", "string"), ("r", "int")])
        best = F.array_max(F.transform(words, lambda w: F.aggregate(
            F.filter(lit, lambda b: b["word"] == w), F.lit(0), lambda a, b: F.greatest(a, b["r"]))))
    out = None
    for a, r in sorted(rank.items(), key=lambda kv: -kv[1]):
        out = F.when(best == r, F.lit(a)) if out is None else out.when(best == r, F.lit(a))
    return out


def byte_offsets(text: Column, hits: Column) -> Column:
    """Hits with ``idx`` / ``len`` in UTF-8 bytes instead of characters (the service's
    regex matcher reports bytes; its keyword matcher is off by w-1 bytes for a last
    character of w bytes, which is not kept)."""
    return F.transform(hits, lambda h: h.withField("idx", F.octet_length(text.substr(F.lit(1), h["idx"])).cast("int"))
                       .withField("len", F.octet_length(text.substr(h["idx"] + 1, h["len"])).cast("int")))


def redact_texts(results: DataFrame, text_col: str = "text", hits_col: str = "hits") -> DataFrame:
    """P5 on a results DataFrame (``moderate(..., keep=("text",))``):
    (id, text_masked, n_masked, n_islands)."""
    m = redact(F.col(text_col), F.col(hits_col))
    return results.select("id", m["text"].alias("text_masked"), m["n_masked"].alias("n_masked"),
                          m["n_islands"].alias("n_islands"))


def moderate_conversations(turns: DataFrame, matchers: list, id_col: str = "id", role_col: str = "role",
                           text_col: str = "text", **kw) -> DataFrame:
    """P7: assistant turns are moderated at the output point, all others (user, system)
    at the input point; the verdict rows carry ``point`` for per-point counts."""
    from tamis.sources.texts import as_contexts
    ctx = as_contexts(turns.withColumn("_point", F.when(F.col(role_col) == "assistant", F.lit(fixed.POINT_OUTPUT))
                                       .otherwise(F.lit(fixed.POINT_INPUT))),
                      id=id_col, text=text_col, point="_point")
    keep = tuple(kw.pop("keep", ())) + ("point",)
    return moderate(ctx, matchers, keep=keep, **kw)
