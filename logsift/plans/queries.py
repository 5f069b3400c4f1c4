"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Inputs are the driver tables (the log fixture is derived from ``events``, the
label fixture from ``events``, documents / labels / embeddings as they are).
Output conventions shared with the oracle SQL: timestamps as epoch µs
(``*_us``), arrays as comma-joined strings, doubles rounded to 6 places,
counts as bigint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.functions import parse as P
from logsift.operators import features as FT
from logsift.operators import labels as L
from logsift.operators import metrics as M
from logsift.operators import order as O
from logsift.operators import outliers as OL
from logsift.operators import split as SP
from logsift.operators import sequences as Q
from logsift.sources import fixtures as X
from logsift.sources import logs as G
from logsift.sources.labels import normalise_labels

TIME_WINDOW = (3600, 0)
TIME_WINDOW_DEFAULT = (60, 0)  # the original configuration's window
TIME_WINDOW_OVERLAP = (3600, 1800)
COUNT_WINDOW = (100, 0)
COUNT_WINDOW_OVERLAP = (100, 30)


def r6(c) -> F.Column:
    return F.round(c.cast("double"), 6)


def us(c) -> F.Column:
    return P.epoch_micros(c)


def parsed_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.parse_logs(X.log_lines(spark, sf_dir), templates="fixture")


SMALL_SLICE = 500  # many slices even on the test tables


def ordered_fixture(spark: SparkSession, sf_dir: str, rows_per_slice: int = O.ROWS_PER_SLICE):
    return Q.order_logs(parsed_fixture(spark, sf_dir), rows_per_slice=rows_per_slice)


def labels_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise_labels(X.label_rows(spark, sf_dir), order_col=None)


# -- parse ------------------------------------------------------------------

def q_parse_logs(spark, sf_dir):
    p = parsed_fixture(spark, sf_dir)
    return p.select("line_no", us(F.col("timestamp")).alias("ts_us"), "level", "component",
                    "message", "block_id", "raw_line",
                    F.col("template_id").cast("long").alias("template_id"))


def q_parse_stats(spark, sf_dir):
    lines = X.log_lines(spark, sf_dir)
    return G.parse_stats(lines, parsed_fixture(spark, sf_dir))


def q_parse_levels(spark, sf_dir):
    return (parsed_fixture(spark, sf_dir).groupBy("level", "component")
            .agg(F.count(F.lit(1)).alias("n")))


# -- text files: reader, line limit, date layout, several ids a line -------------------

def text_files(spark, sf_dir, parts: int = 4):
    """The fixture lines as text files whose path order is the line order."""
    path = _scratch(spark, "lines")
    lines = X.log_lines(spark, sf_dir, persist=False)
    lines.repartitionByRange(parts, "line_no").sortWithinPartitions("line_no").select("value").write.text(path)
    return path


def _text_lines(spark, sf_dir, max_lines=None):
    """SC1-SC3: several files, read in splits of 64 KB."""
    path, old = text_files(spark, sf_dir), spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(64 << 10))
    try:
        lines = G.read_log_text(spark, path, max_lines).persist()
        lines.count()  # the plan must run under the setting it was numbered under
        return lines
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def _parsed_out(p: DataFrame) -> DataFrame:
    return p.select("line_no", us(F.col("timestamp")).alias("ts_us"), "level", "component", "message", "block_id", "raw_line")


def q_text_parse(spark, sf_dir):
    return _parsed_out(G.parse_logs(_text_lines(spark, sf_dir), templates=None))


MAX_LINES = 700


def q_text_max_lines(spark, sf_dir):
    """SC2: the reader's own line limit."""
    return _parsed_out(G.parse_logs(_text_lines(spark, sf_dir, MAX_LINES), templates=None))


def q_text_yymmdd(spark, sf_dir):
    return _parsed_out(G.parse_logs(_text_lines(spark, sf_dir), templates=None, date_layout="yymmdd"))


def q_text_all_blocks(spark, sf_dir):
    """Every second line names a further block after its message; each id gives a row."""
    lines = _text_lines(spark, sf_dir)
    more = F.when(F.col("line_no") % 2 == 0, F.concat("value", F.lit(" blk_"), F.col("line_no").cast("string"))).otherwise(F.col("value"))
    return _parsed_out(G.parse_logs(lines.withColumn("value", more), templates=None, all_blocks=True))


# -- sequences ----------------------------------------------------------------

def _seq_out(df: DataFrame) -> DataFrame:
    return df.select("seq_id", F.col("id").cast("string").alias("id"),
                     P.ids_to_string(F.col("template_sequence")).alias("template_sequence_str"),
                     F.col("length").cast("long").alias("length"),
                     us(F.col("start_time")).alias("start_us"), us(F.col("end_time")).alias("end_us"),
                     *([r6(F.col("time_span")).alias("time_span")] if "time_span" in df.columns
                       else [F.col("window_size").cast("long").alias("window_size")]))


def q_block_sequences(spark, sf_dir):
    return _seq_out(Q.block_sequences(ordered_fixture(spark, sf_dir)))


def q_block_sequences_sliced(spark, sf_dir):
    return _seq_out(Q.block_sequences(ordered_fixture(spark, sf_dir, SMALL_SLICE)))


def q_time_windows(spark, sf_dir):
    return _seq_out(Q.time_windows(ordered_fixture(spark, sf_dir), *TIME_WINDOW))


def q_time_windows_default(spark, sf_dir):
    return _seq_out(Q.time_windows(ordered_fixture(spark, sf_dir), *TIME_WINDOW_DEFAULT))


def q_time_windows_overlap(spark, sf_dir):
    return _seq_out(Q.time_windows(ordered_fixture(spark, sf_dir), *TIME_WINDOW_OVERLAP))


def _cw_out(df: DataFrame) -> DataFrame:
    return df.select("window_id", "start_idx", "end_idx", us(F.col("start_time")).alias("start_us"),
                     us(F.col("end_time")).alias("end_us"), r6(F.col("time_span")).alias("time_span"),
                     F.col("log_count").cast("long").alias("log_count"), "template_sequence_str",
                     F.col("unique_templates").cast("long").alias("unique_templates"))


def q_count_windows(spark, sf_dir):
    return _cw_out(Q.count_windows(ordered_fixture(spark, sf_dir), *COUNT_WINDOW))


def q_count_windows_sliced(spark, sf_dir):
    return _cw_out(Q.count_windows(ordered_fixture(spark, sf_dir, SMALL_SLICE), *COUNT_WINDOW))


def q_count_windows_overlap(spark, sf_dir):
    return _cw_out(Q.count_windows(ordered_fixture(spark, sf_dir), *COUNT_WINDOW_OVERLAP))


def q_window_means(spark, sf_dir):
    m = Q.window_means(Q.count_windows(ordered_fixture(spark, sf_dir), *COUNT_WINDOW))
    return m.select(r6(F.col("avg_log_count")).alias("avg_log_count"),
                    r6(F.col("avg_time_span")).alias("avg_time_span"))


def q_sequence_logs(spark, sf_dir):
    s = Q.sequence_logs(ordered_fixture(spark, sf_dir), *TIME_WINDOW)
    return s.select("line_no", "sequence_id", "sequence_type")


def q_sequence_stats(spark, sf_dir):
    o = ordered_fixture(spark, sf_dir)
    seqs = Q.block_sequences(o).select("type", "length").unionByName(
        Q.time_windows(o, *TIME_WINDOW).select("type", "length"))
    return Q.sequence_stats(seqs)


# -- labels / training set ----------------------------------------------------

def q_label_lookup(spark, sf_dir):
    return labels_fixture(spark, sf_dir)


def _training(spark, sf_dir):
    return L.block_training(Q.block_sequences(ordered_fixture(spark, sf_dir)),
                            labels_fixture(spark, sf_dir))


def q_block_training(spark, sf_dir):
    t = _training(spark, sf_dir)
    return t.select("block_id", F.col("sequence_length").cast("long").alias("sequence_length"),
                    "template_sequence_str", us(F.col("start_time")).alias("start_us"),
                    us(F.col("end_time")).alias("end_us"), r6(F.col("time_span")).alias("time_span"),
                    F.col("anomaly_binary_val").cast("long").alias("anomaly_binary_val"),
                    "anomaly_labels", F.col("anomaly_label").cast("long").alias("anomaly_label"))


def q_label_distribution(spark, sf_dir):
    d = L.label_distribution(_training(spark, sf_dir))
    return d.select(F.col("anomaly_binary_val").cast("long").alias("anomaly_binary_val"), "n")


def q_column_summary(spark, sf_dir):
    s = L.column_summary(_training(spark, sf_dir), "time_span")
    return s.select("column", "count", *[r6(F.col(c)).alias(c) for c in
                                         ["mean", "std", "min", "p25", "p50", "p75", "max"]])


# -- features -----------------------------------------------------------------

NGRAMS = (1, 2)
VOCAB_TOPK = 10
WINDOW_VOCAB = 20


def _n_blocks(o) -> int:
    """Documents = blocks with a valid-time log (from the cached narrow table)."""
    return o.df.filter(F.col("block_id").isNotNull()).select("block_id").distinct().count()


def _block_terms(spark, sf_dir):
    o = ordered_fixture(spark, sf_dir)
    return o, FT.ngram_terms(Q.block_pieces(o), ["seq_id"], NGRAMS)


def q_ngram_counts(spark, sf_dir):
    _, t = _block_terms(spark, sf_dir)
    return t.select("seq_id", "term", F.col("tf").cast("long").alias("tf"))


def q_ngram_counts_sliced(spark, sf_dir):
    o = ordered_fixture(spark, sf_dir, SMALL_SLICE)
    t = FT.ngram_terms(Q.block_pieces(o), ["seq_id"], NGRAMS)
    return t.select("seq_id", "term", F.col("tf").cast("long").alias("tf"))


def q_vocab_topk(spark, sf_dir):
    o, t = _block_terms(spark, sf_dir)
    n_docs = _n_blocks(o)
    top = FT.top_terms(t, VOCAB_TOPK)
    return top.select("term", F.col("cf").cast("long").alias("cf"),
                      F.col("doc_freq").cast("long").alias("doc_freq"),
                      r6(F.log((F.lit(1 + n_docs)) / (F.col("doc_freq") + 1)) + 1).alias("idf"))


def q_tfidf(spark, sf_dir):
    o, t = _block_terms(spark, sf_dir)
    n_docs = _n_blocks(o)
    model = FT.fit_tfidf(t, n_docs, 1000)
    return FT.tfidf(t, model, ["seq_id"]).select("seq_id", "term", r6(F.col("tfidf")).alias("tfidf"))


def _count_windows(spark, sf_dir):
    return Q.count_windows(ordered_fixture(spark, sf_dir), *COUNT_WINDOW)


def q_tfidf_windows(spark, sf_dir):
    w = _count_windows(spark, sf_dir)
    t = FT.ngram_terms(Q.window_pieces(w), ["window_id"], NGRAMS)
    model = FT.fit_tfidf(t, w.count(), WINDOW_VOCAB)
    return FT.tfidf(t, model, ["window_id"]).select("window_id", "term",
                                                   r6(F.col("tfidf")).alias("tfidf"))


def q_scaled_metadata(spark, sf_dir):
    b = Q.block_sequences(ordered_fixture(spark, sf_dir)).withColumnRenamed("length", "sequence_length")
    sc = FT.scale(b, FT.BLOCK_META)
    return sc.select(F.col("seq_id").alias("block_id"),
                     *[r6(F.col(c + "_scaled")).alias(c + "_scaled") for c in FT.BLOCK_META])


def q_scaled_window_metadata(spark, sf_dir):
    sc = FT.scale(_count_windows(spark, sf_dir), FT.WINDOW_META)
    return sc.select("window_id", *[r6(F.col(c + "_scaled")).alias(c + "_scaled")
                                    for c in FT.WINDOW_META])


def q_tfidf_unbounded(spark, sf_dir):
    """T4 without a limit: every n-gram of the blocks, numbered and weighted by a distributed dictionary."""
    o, terms = _block_terms(spark, sf_dir)
    vocabulary = FT.dictionary(terms, _n_blocks(o))
    return FT.tfidf_by_dictionary(terms, vocabulary, ["seq_id"]).select("seq_id", "term", "feature_idx", r6(F.col("tfidf")).alias("tfidf"))


SAVED_VOCAB = 12


def _saved_features(spark, sf_dir):
    """A feature model of all blocks, saved and loaded again, with its names and stats."""
    from logsift.sources.io import load_models, save_models
    o = ordered_fixture(spark, sf_dir)
    blocks = Q.block_headers(o).withColumnRenamed("length", "sequence_length")
    pieces = Q.block_pieces(o)
    fm = FT.fit_features(blocks, pieces, "seq_id", FT.BLOCK_META, SAVED_VOCAB, NGRAMS)
    path = save_models(spark, _scratch(spark, "models"), fm, stats={"blocks": fm.tfidf.n_docs})
    return blocks, pieces, load_models(spark, path)


def q_saved_features(spark, sf_dir):
    """SK4 + SK5 + FE6: names, document frequencies, weights and scaler as they come back from disk."""
    _, _, got = _saved_features(spark, sf_dir)
    fm = got["feature_model"]
    rows = [(d, w, None) for d, w in zip(fm.tfidf.doc_freq, fm.tfidf.idf)] + [(None, s, m) for m, s in zip(fm.scaler.mean, fm.scaler.scale)]
    rows = [(i, n, d, w, m, int(got["stats"]["blocks"])) for i, (n, (d, w, m)) in enumerate(zip(got["feature_names"], rows, strict=True))]
    out = spark.createDataFrame(rows, "position long, name string, doc_freq long, weight double, mean double, blocks long")
    return out.select("position", "name", "doc_freq", r6(F.col("weight")).alias("weight"), r6(F.col("mean")).alias("mean"), "blocks")


def q_feature_vectors(spark, sf_dir):
    """FE5 + FE7: text and metadata features of every block, transformed by the loaded model."""
    blocks, pieces, got = _saved_features(spark, sf_dir)
    ft = FT.feature_table(blocks, pieces, "seq_id", got["feature_model"])
    names = F.array(*[F.lit(n) for n in got["feature_names"]])
    pairs = ft.select("seq_id", F.explode(F.arrays_zip("feat_idx", "feat_val")).alias("x"))
    return pairs.select("seq_id", F.get(names, F.col("x.feat_idx")).alias("name"), r6(F.col("x.feat_val")).alias("value"))


# -- split / metrics ------------------------------------------------------------

RULE_TEMPLATE, RULE_CUT = 3, 0.2


def _rule_scored(spark, sf_dir):
    """Blocks scored by a frequency rule (share of one template) -- a stand-in
    classifier whose outputs SQL can reproduce, so the metric operators have
    an oracle."""
    t = _training(spark, sf_dir).filter(F.col("anomaly_binary_val").isin(0, 1))
    share = (F.size(F.filter("template_sequence", lambda x: x == RULE_TEMPLATE))
             / F.col("sequence_length"))
    return t.select("block_id", F.col("anomaly_binary_val").alias("label"),
                    share.alias("score"), (share > RULE_CUT).cast("int").alias("prediction"))


def q_stratified_split(spark, sf_dir):
    s = SP.stratified_split(_training(spark, sf_dir), "block_id", "anomaly_binary_val")
    return s.select("block_id", F.col("anomaly_binary_val").cast("long").alias("anomaly_binary_val"),
                    "split")


def q_stratified_split_rare(spark, sf_dir):
    """ML1 with a class of two members: the two smallest event ids of errors against all other errors."""
    e = X.events(spark, sf_dir).filter(F.col("event_type") == "error").select("event_id")
    first = [r["event_id"] for r in e.orderBy("event_id").limit(2).collect()]
    e = e.withColumn("label", F.col("event_id").isin(first).cast("int"))
    return SP.stratified_split(e, "event_id", "label").select("event_id", F.col("label").cast("long").alias("label"), "split")


def q_confusion(spark, sf_dir):
    c = M.confusion(_rule_scored(spark, sf_dir))
    return c.select(F.col("label").cast("long").alias("label"),
                    F.col("prediction").cast("long").alias("prediction"),
                    F.col("n").cast("long").alias("n"))


def q_class_report(spark, sf_dir):
    r = M.class_report(_rule_scored(spark, sf_dir))
    return r.select("class", r6(F.col("precision")).alias("precision"),
                    r6(F.col("recall")).alias("recall"), r6(F.col("f1")).alias("f1"),
                    F.col("support").cast("long").alias("support"))


def q_roc_auc(spark, sf_dir):
    a = M.roc_auc(_rule_scored(spark, sf_dir), "label", "score")
    return a.select(r6(F.col("auc")).alias("auc"), "positives", "negatives")


# -- outlier reports -------------------------------------------------------------

CONTAMINATION, TOP_N = 0.1, 10


def _window_rule(spark, sf_dir):
    """Count windows scored by a frequency rule (minus the share of one
    template; lower = more anomalous) so threshold, top-N and evaluation have
    a SQL oracle."""
    o = ordered_fixture(spark, sf_dir)
    pos = Q.log_positions(o)
    w = Q.count_windows(o, *COUNT_WINDOW, positions=pos)
    share = F.size(F.filter("template_sequence", lambda x: x == RULE_TEMPLATE)) / F.col("log_count")
    return o, pos, w.select("window_id", "log_count", (-share).alias("anomaly_score"))


def q_contamination_threshold(spark, sf_dir):
    _, _, scored = _window_rule(spark, sf_dir)
    t = OL.contamination_threshold(scored, CONTAMINATION)
    return spark.createDataFrame([(None if t is None else round(t, 6),)], "threshold double")


def q_top_windows(spark, sf_dir):
    _, _, scored = _window_rule(spark, sf_dir)
    top = OL.top_anomalous(scored, TOP_N)
    return top.select("window_id", r6(F.col("anomaly_score")).alias("anomaly_score"),
                      F.col("log_count").cast("long").alias("log_count"))


def q_evaluate_windows(spark, sf_dir):
    o, pos, scored = _window_rule(spark, sf_dir)
    t = OL.contamination_threshold(scored, CONTAMINATION)
    pred = OL.flag(scored, t)
    mem = Q.count_window_membership(pos, o.n_rows, *COUNT_WINDOW)
    truth = OL.window_truth(mem, labels_fixture(spark, sf_dir)).select(
        F.concat(F.lit("window_"), F.col("_j").cast("string")).alias("window_id"), "truth")
    ev = OL.evaluate_windows(pred, truth)
    return ev.select(*[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1_score")],
                     *[F.col(c).cast("long").alias(c) for c in
                       ("true_positives", "false_positives", "true_negatives", "false_negatives",
                        "total", "actual_positives", "predicted_positives")])


# -- models -----------------------------------------------------------------------

def q_isolation_forest(spark, sf_dir):
    from logsift.plans.runs import run_windows
    run = run_windows(ordered_fixture(spark, sf_dir), labels_fixture(spark, sf_dir), models=("isolation_forest",))
    return run.scored.select("window_id", r6(F.col("anomaly_score")).alias("anomaly_score"), F.col("is_anomaly").cast("long").alias("is_anomaly"))


def _block_run(spark, sf_dir, models):
    from logsift.plans.runs import run_blocks
    return run_blocks(ordered_fixture(spark, sf_dir), labels_fixture(spark, sf_dir), models=models)


REPORT_SCHEMA = ("model string, split string, class string, precision double, recall double, "
                 "f1 double, support long")


def _report_or_empty(spark, run):
    """The class report per (model, split); empty with the same schema when
    there was nothing to train on (one class only, D11)."""
    if run.report is None:
        return spark.createDataFrame([], REPORT_SCHEMA)
    return run.report.select("model", "split", "class", "precision", "recall", "f1", "support")


def q_logreg(spark, sf_dir):
    return _report_or_empty(spark, _block_run(spark, sf_dir, ("logistic_regression",)))


PREDICTION_SCHEMA = "block_id string, split string, y_true long, y_pred long, y_proba double"


def _metadata_model(spark, sf_dir):
    """ML2 on the two scaled metadata columns of the labelled blocks, fitted to the loss's minimum: (rows, models)."""
    from logsift.operators import supervised as SV
    from logsift.session import staged
    t = _training(spark, sf_dir).filter(F.col("anomaly_binary_val").isin(0, 1)).select(
        "block_id", F.col("anomaly_binary_val").alias("label"), *FT.BLOCK_META)
    t = FT.scale(SP.stratified_split(t, "block_id", "label"), FT.BLOCK_META)
    t = t.withColumn("feat_idx", F.array(F.lit(0), F.lit(1))).withColumn("feat_val", F.array(*[F.col(c + "_scaled") for c in FT.BLOCK_META]))
    t = staged(t.select("block_id", "label", "split", SV.to_vector(2).alias("features")), "metadata-features")
    train = t.filter("split = 'train'")
    if train.select("label").distinct().count() < 2:  # D11
        return t, {}
    return t, SV.train_block_models(train, models=("logistic_regression",), lr_tol=1e-13)


def q_logreg_coefficients(spark, sf_dir):
    """ML2: the fitted weights, held against Newton steps in SQL."""
    _, models = _metadata_model(spark, sf_dir)
    rows = [(n, float(v)) for m in models.values() for n, v in zip(("intercept", *FT.BLOCK_META), (m.intercept, *m.coefficients))]
    return spark.createDataFrame(rows, "name string, value double").select("name", F.round("value", 4).alias("value"))


def q_predictions(spark, sf_dir):
    """ML4 + ML8: class and probability of every labelled block with the named model."""
    from logsift.operators import supervised as SV
    rows, models = _metadata_model(spark, sf_dir)
    if not models:
        return spark.createDataFrame([], PREDICTION_SCHEMA)
    return SV.predict(models, rows, "logistic_regression").select(
        "block_id", "split", F.col("label").cast("long").alias("y_true"), F.col("prediction").cast("long").alias("y_pred"),
        F.round("probability", 4).alias("y_proba"))


def q_training_stats(spark, sf_dir):
    """The counts that a training run reports."""
    from logsift.plans.runs import training_stats
    stats = training_stats(_block_run(spark, sf_dir, ("logistic_regression",)), spark)
    whole = ["total_samples", "unlabelled_dropped", "train_samples", "val_samples", "test_samples", "feature_count", "tfidf_features"]
    return stats.select(*[F.col(c).try_cast("long").alias(c) for c in whole], r6(F.col("anomaly_rate").try_cast("double")).alias("anomaly_rate"))


def q_boosted(spark, sf_dir):
    return _report_or_empty(spark, _block_run(spark, sf_dir, ("boosted_trees",)))


# -- templates --------------------------------------------------------------------

def q_token_patterns(spark, sf_dir):
    from logsift.operators.templates import token_patterns
    t = token_patterns(G.parse_logs(X.log_lines(spark, sf_dir), templates=None))
    return t.select("pattern", F.col("token_count").cast("long").alias("token_count"), "leaf_prefix",
                    F.col("lines").cast("long").alias("lines"), "first_line")


def q_templates(spark, sf_dir):
    from logsift.operators.templates import template_summary
    t = template_summary(G.parse_logs(X.log_lines(spark, sf_dir), templates=None))
    return t.select(F.col("template_id").cast("long").alias("template_id"), "template_str", "lines", "first_line")


# -- streaming -------------------------------------------------------------------

STREAM_WINDOW = "3600 seconds"


#: Lag that the fixture's lines may have: its whole time range, so none is late.
STREAM_WATERMARK = "40 days"


def _stream_parsed(spark, sf_dir):
    """ST1 on text: the fixture as files that arrive one by one, then the end marker."""
    from logsift.sources.fixtures import fixture_template_id
    from logsift.streaming import stream as ST
    path = text_files(spark, sf_dir)
    ST.write_end_marker(spark, path)
    return ST.parse_stream(ST.read_text_stream(spark, path, 1)).withColumn("template_id", fixture_template_id())


def _drain(spark, stream, name):
    """Run a stream to its end into parquet under the shared checkpoint folder; its rows.  Late rows are an error."""
    import uuid

    from logsift.streaming import stream as ST
    tag = uuid.uuid4().hex
    out = ST.checkpoint_location(spark, f"{name}-out-{tag}")
    q = ST.run_to_parquet(stream, out, ST.checkpoint_location(spark, f"{name}-ckpt-{tag}"))
    if ST.late_rows(q):
        raise RuntimeError(f"{ST.late_rows(q)} lines came later than the watermark")
    return spark.read.parquet(out)


def _stream_folders(spark, name):
    import uuid

    from logsift.streaming import stream as ST
    tag = uuid.uuid4().hex
    return ST.checkpoint_location(spark, f"{name}-out-{tag}"), ST.checkpoint_location(spark, f"{name}-ckpt-{tag}")


def _ended(query):
    """Wait for a stream's end; late rows are an error."""
    from logsift.streaming import stream as ST
    query.awaitTermination()
    if ST.late_rows(query):
        raise RuntimeError(f"{ST.late_rows(query)} lines came later than the watermark")


def q_stream_time_windows(spark, sf_dir):
    """ST1 + ST2: every window of the input, the last ones included, from pieces to ordered sequences."""
    from logsift.streaming import stream as ST
    pieces = _drain(spark, ST.window_piece_stream(_stream_parsed(spark, sf_dir), STREAM_WINDOW, watermark=STREAM_WATERMARK), "stw")
    ordered = ST.ordered_pieces(ST.window_rows(pieces), ["window_id"])
    start = F.substring_index("window_id", "_", -1).cast("long")
    return ST.assembled(ordered, ["window_id"]).select(
        start.alias("start_us"), (start + TIME_WINDOW[0] * 1_000_000).alias("end_us"),
        P.ids_to_string(F.col("template_sequence")).alias("template_sequence_str"), F.col("length").cast("long").alias("length"))


def q_stream_templates(spark, sf_dir):
    """ST4: each line's template from the stateful miner (ids are hashes, so the text stands for them)."""
    from logsift.streaming import stream as ST
    parsed = _stream_parsed(spark, sf_dir).filter(F.col("component") != "end")
    query, miner = ST.mine_template_stream(parsed, *_stream_folders(spark, "stt"))
    _ended(query)
    return miner.lines.read().groupBy("template_str").agg(F.count(F.lit(1)).alias("lines"), F.min("line_no").alias("first_key"),
                                                          F.count_distinct("template_id").alias("ids"))


STREAM_SCORE_COLUMNS = ["log_count", "unique_templates"]


def q_stream_scores(spark, sf_dir):
    """ST5: hourly windows of the stream, scored as they close by a covariance fitted on the batch windows."""
    from logsift.operators.robust_cov import classical_covariance
    from logsift.streaming import stream as ST
    batch = Q.time_windows(ordered_fixture(spark, sf_dir), *TIME_WINDOW).select(
        "seq_id", F.col("length").alias("log_count"), F.size(F.array_distinct("template_sequence")).alias("unique_templates"))
    batch = batch.select("seq_id", *[F.col(c).cast("double").alias(c) for c in STREAM_SCORE_COLUMNS])
    model = classical_covariance(batch, STREAM_SCORE_COLUMNS)
    threshold = OL.contamination_threshold(model.score(batch), CONTAMINATION)

    def score(windows, pieces):
        return OL.flag(model.score(windows.select("window_id", *[F.col(c).cast("double").alias(c) for c in STREAM_SCORE_COLUMNS])), threshold)

    pieces = ST.window_piece_stream(_stream_parsed(spark, sf_dir), STREAM_WINDOW, watermark=STREAM_WATERMARK)
    query, table = ST.score_closed_windows(pieces, score, *_stream_folders(spark, "sts"))
    _ended(query)
    return table.read().select(us(F.col("start_time")).alias("start_us"), "log_count", r6(F.col("anomaly_score")).alias("anomaly_score"),
                               F.col("is_anomaly").cast("long").alias("is_anomaly"))


STREAM_GAP_SECONDS = 1800


def q_stream_block_sessions(spark, sf_dir):
    """ST3: block sequences closed after 30 minutes without a log of the block: bounds by state, lines joined to them."""
    from logsift.streaming import stream as ST
    parsed = _stream_parsed(spark, sf_dir)
    bounds = _drain(spark, ST.block_session_bounds(parsed, f"{STREAM_GAP_SECONDS} seconds", watermark=STREAM_WATERMARK), "sbs")
    rows = _drain(spark, ST.block_rows(parsed), "sbr")
    keys = ["block_id", "start_us"]
    seqs = ST.assembled(ST.ordered_pieces(ST.session_rows(bounds, rows), keys), keys)
    ends = bounds.select("block_id", us(F.col("start_time")).alias("start_us"), us(F.col("end_time")).alias("end_us"))
    return seqs.join(ends, keys).select(
        F.concat(F.lit("block_"), F.col("block_id")).alias("seq_id"), "start_us", "end_us",
        P.ids_to_string(F.col("template_sequence")).alias("template_sequence_str"),
        F.col("length").cast("long").alias("length"), r6((F.col("end_us") - F.col("start_us")) / 1e6).alias("time_span"))


def q_mahalanobis_once(spark, sf_dir):
    """OD5's distance with the classical mean and covariance, on two embedding coordinates."""
    from logsift.operators.robust_cov import classical_covariance
    e = _embeddings(spark, sf_dir).select("vec_id", "e0", "e1")
    return classical_covariance(e, ["e0", "e1"]).score(e).select("vec_id", r6(F.col("anomaly_score")).alias("anomaly_score"))


def q_robust_cov_embeddings(spark, sf_dir):
    """OD5 on data of full rank: five embedding coordinates."""
    from logsift.operators.robust_cov import fit_robust_covariance
    cols = [f"e{i}" for i in range(5)]
    e = _embeddings(spark, sf_dir).select("vec_id", *cols)
    m = fit_robust_covariance(e, cols, contamination=CONTAMINATION, key="vec_id")
    return m.predict(m.score(e)).select("vec_id", "anomaly_score", "is_anomaly")


def q_lof_leaves(spark, sf_dir):
    """OD4 with leaves of 16 points, so that balls cross leaves."""
    from logsift.operators.lof import local_outlier_factor
    w = FT.scale(_count_windows(spark, sf_dir), FT.WINDOW_META)
    cols = [c + "_scaled" for c in FT.WINDOW_META]
    out, _ = local_outlier_factor(w.select("window_id", *cols), "window_id", cols, LOF_NEIGHBORS, contamination=None, leaf_size=16)
    return out.select("window_id", r6(F.col("anomaly_score")).alias("anomaly_score"))


def q_lof_projected(spark, sf_dir):
    """OD4 on the embeddings projected to three dimensions (sums of every third coordinate), where
    exact neighbours don't need all pairs."""
    from logsift.operators.lof import local_outlier_factor
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    third = lambda k: F.aggregate(F.filter("embedding", lambda x, i: i % 3 == k), F.lit(0.0), lambda a, x: a + x.cast("double"))
    cols = ["p0", "p1", "p2"]
    out, _ = local_outlier_factor(e.select("vec_id", *[third(k).alias(c) for k, c in enumerate(cols)]), "vec_id", cols, LOF_NEIGHBORS,
                                  contamination=None, leaf_size=64)
    return out.select("vec_id", r6(F.col("anomaly_score")).alias("anomaly_score"))


def q_robust_cov(spark, sf_dir):
    """OD5 on the scaled window metadata (log count, span, distinct templates)."""
    from logsift.operators.robust_cov import fit_robust_covariance
    w = FT.scale(_count_windows(spark, sf_dir), FT.WINDOW_META)
    cols = [c + "_scaled" for c in FT.WINDOW_META]
    m = fit_robust_covariance(w, cols, contamination=CONTAMINATION, key="window_id")
    return m.predict(m.score(w)).select("window_id", "anomaly_score", "is_anomaly")


LOF_NEIGHBORS = 20


def q_lof(spark, sf_dir):
    """OD4 on the scaled window metadata; exact kNN without all pairs."""
    from logsift.operators.lof import local_outlier_factor
    w = FT.scale(_count_windows(spark, sf_dir), FT.WINDOW_META)
    cols = [c + "_scaled" for c in FT.WINDOW_META]
    out, _ = local_outlier_factor(w.select("window_id", *cols), "window_id", cols, LOF_NEIGHBORS,
                                  contamination=None)
    return out.select("window_id", r6(F.col("anomaly_score")).alias("anomaly_score"))


def _window_components(spark, sf_dir):
    """Count windows by principal components of all their text and metadata features."""
    from logsift.api import COMPONENTS, principal_columns
    from logsift.plans.runs import window_features
    pos, _, ft, fm, _ = window_features(ordered_fixture(spark, sf_dir), *COUNT_WINDOW)
    low, cols = principal_columns(ft, "window_id", fm.size, COMPONENTS)
    pos.unpersist()
    return low, cols


def q_robust_cov_features(spark, sf_dir):
    """OD5 on all window features, by their principal components."""
    from logsift.operators.robust_cov import fit_robust_covariance
    low, cols = _window_components(spark, sf_dir)
    m = fit_robust_covariance(low, cols, contamination=CONTAMINATION, key="window_id")
    return m.predict(m.score(low)).select("window_id", "anomaly_score", "is_anomaly")


def q_lof_features(spark, sf_dir):
    """OD4 on all window features, by their principal components."""
    from logsift.operators.lof import local_outlier_factor
    low, cols = _window_components(spark, sf_dir)
    out, _ = local_outlier_factor(low, "window_id", cols, LOF_NEIGHBORS, contamination=None)
    return out.select("window_id", r6(F.col("anomaly_score")).alias("anomaly_score"))


# -- reports and I/O round trips ---------------------------------------------------

def q_sequence_examples(spark, sf_dir):
    """A7 examples: the first five sequence ids over block and time sequences."""
    o = ordered_fixture(spark, sf_dir)
    seqs = Q.block_sequences(o).select("seq_id", "type", "length").unionByName(
        Q.time_windows(o, *TIME_WINDOW).select("seq_id", "type", "length"))
    return Q.example_sequences(seqs).select("seq_id", "type", F.col("length").cast("long").alias("length"))


def q_score_range(spark, sf_dir):
    """A12 over the rule-scored count windows."""
    _, _, scored = _window_rule(spark, sf_dir)
    return M.score_range(scored).select(r6(F.col("min_score")).alias("min_score"),
                                        r6(F.col("max_score")).alias("max_score"))


def _scratch(spark, name):
    import uuid

    from logsift.session import scratch_path
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def q_label_csv(spark, sf_dir):
    """SC4 + J2/J3: label rows written as a CSV file, read back with the label reader."""
    from logsift.sources.labels import read_labels
    path = _scratch(spark, "labels") + ".csv"
    X.label_rows(spark, sf_dir).write.option("header", True).csv(path)
    return read_labels(spark, path)


def q_labels_last_wins(spark, sf_dir):
    """Every key twice in the file, the second time with the other label for a third of them."""
    from logsift.sources.labels import read_labels
    path = _scratch(spark, "labels") + ".csv"
    rows = X.label_rows(spark, sf_dir)
    other = F.when(F.length("BlockId") % 3 == 0, F.lit("Anomaly")).otherwise(F.col("Label"))
    twice = rows.withColumn("_o", F.lit(0)).unionByName(rows.withColumn("Label", other).withColumn("_o", F.lit(1)))
    twice.repartitionByRange(3, "_o", "BlockId").sortWithinPartitions("_o", "BlockId").select("BlockId", "Label").write.option("header", True).csv(path)
    return read_labels(spark, path)


def q_window_dataset_roundtrip(spark, sf_dir):
    """SK1 + SC6 + F7: count windows written as CSV, loaded, the id string parsed back to an array."""
    from logsift.sources.io import load_window_data, save_dataset
    path = _scratch(spark, "windows") + ".csv"
    save_dataset(_count_windows(spark, sf_dir).drop("unique_templates"), path, "csv")
    t = load_window_data(spark, path)
    return t.select("window_id", F.col("log_count").cast("long").alias("log_count"), r6(F.col("time_span")).alias("time_span"),
                    "template_sequence_str", F.col("unique_templates").cast("long").alias("unique_templates"),
                    F.aggregate("template_sequence", F.lit(0).cast("long"), lambda a, x: a * 31 % 1000003 + x).alias("ids_hash"),
                    F.size("template_sequence").cast("long").alias("ids"))


def q_block_dataset_roundtrip(spark, sf_dir):
    """SK1 + SC5: block training set written as CSV, loaded and validated."""
    from logsift.sources.io import load_block_data, save_dataset
    path = _scratch(spark, "blocks") + ".csv"
    save_dataset(_training(spark, sf_dir), path, "csv")
    t = load_block_data(spark, path)
    return t.select("block_id", F.col("sequence_length").cast("long").alias("sequence_length"),
                    "template_sequence_str", us(F.col("start_time")).alias("start_us"),
                    us(F.col("end_time")).alias("end_us"), r6(F.col("time_span")).alias("time_span"),
                    F.col("anomaly_binary_val").cast("long").alias("anomaly_binary_val"),
                    "anomaly_labels", F.col("anomaly_label").cast("long").alias("anomaly_label"))


PIECE_LENGTH = 20
TRAINING_HEADER = ("block_id string, sequence_length long, start_time timestamp_ntz, end_time timestamp_ntz, time_span double, "
                   "anomaly_binary_val int, anomaly_labels string, anomaly_label int")


def _stored_blocks(spark, sf_dir):
    o = ordered_fixture(spark, sf_dir, SMALL_SLICE)
    return o, Q.stored_pieces(Q.block_pieces(o), ["seq_id"], PIECE_LENGTH)


def q_block_sequences_pieces(spark, sf_dir):
    """A1 + SK1 + SC5 without a row that grows: pieces of 20 ids and headers, written as JSON and read back."""
    from logsift.sources.io import load_pieces, save_pieces
    o, stored = _stored_blocks(spark, sf_dir)
    path = save_pieces(Q.block_headers(o), stored, _scratch(spark, "block-pieces"), "json")
    schema = "seq_id string, type string, id string, length long, start_time timestamp_ntz, end_time timestamp_ntz, time_span double"
    headers, pieces = load_pieces(spark, path, schema, "json")
    return headers.join(pieces, "seq_id").select(
        "seq_id", "id", F.col("length").alias("length"), us(F.col("start_time")).alias("start_us"), us(F.col("end_time")).alias("end_us"),
        r6(F.col("time_span")).alias("time_span"), "piece", "first_position", P.ids_to_string(F.col("ids")).alias("ids"))


def q_block_training_pieces(spark, sf_dir):
    """A5 + SK1 + SC5: labelled headers and pieces through CSV; n-grams of a block from its stored pieces."""
    from logsift.sources.io import load_pieces, save_pieces
    o, stored = _stored_blocks(spark, sf_dir)
    training = L.block_training_headers(Q.block_headers(o), labels_fixture(spark, sf_dir))
    path = save_pieces(training, stored.withColumnRenamed("seq_id", "block_id"), _scratch(spark, "training-pieces"), "csv")
    headers, pieces = load_pieces(spark, path, TRAINING_HEADER, "csv", "block_id")
    grams = FT.ngram_terms(Q.feature_pieces(pieces, "block_id"), ["block_id"], NGRAMS).groupBy("block_id").agg(
        F.sum("tf").cast("long").alias("grams"), F.count(F.lit(1)).alias("terms"))
    return headers.join(grams, "block_id").select(
        "block_id", "sequence_length", r6(F.col("time_span")).alias("time_span"), F.col("anomaly_binary_val").cast("long").alias("anomaly_binary_val"),
        "anomaly_labels", F.col("anomaly_label").cast("long").alias("anomaly_label"), "grams", "terms")


# -- outlier operators on the embeddings table ------------------------------------

EMB_DIM = 64


def _embeddings(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}")
                                for i in range(EMB_DIM)])


def q_lof_embeddings(spark, sf_dir):
    """OD4 on the 64-dimensional embedding vectors."""
    from logsift.operators.lof import local_outlier_factor
    cols = [f"e{i}" for i in range(EMB_DIM)]
    out, _ = local_outlier_factor(_embeddings(spark, sf_dir), "vec_id", cols, LOF_NEIGHBORS,
                                  contamination=None)
    return out.select("vec_id", r6(F.col("anomaly_score")).alias("anomaly_score"))


def q_isolation_forest_embeddings(spark, sf_dir):
    """OD1-OD3 on the embedding vectors (dense rows as sparse arrays)."""
    from logsift.operators.iforest import fit_isolation_forest
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    feats = e.select("vec_id", F.sequence(F.lit(0), F.lit(EMB_DIM - 1)).alias("feat_idx"),
                     F.col("embedding").cast("array<double>").alias("feat_val"))
    m = fit_isolation_forest(feats, "vec_id", EMB_DIM, contamination=CONTAMINATION)
    out = m.predict(m.score(feats, "vec_id"))
    return out.select("vec_id", r6(F.col("anomaly_score")).alias("anomaly_score"), F.col("is_anomaly").cast("long").alias("is_anomaly"))


QUERIES = {
    "parse_logs": q_parse_logs,
    "parse_stats": q_parse_stats,
    "parse_levels": q_parse_levels,
    "block_sequences": q_block_sequences,
    "time_windows": q_time_windows,
    "time_windows_overlap": q_time_windows_overlap,
    "time_windows_default": q_time_windows_default,
    "count_windows": q_count_windows,
    "count_windows_overlap": q_count_windows_overlap,
    "window_means": q_window_means,
    "sequence_logs": q_sequence_logs,
    "sequence_stats": q_sequence_stats,
    "label_lookup": q_label_lookup,
    "block_training": q_block_training,
    "label_distribution": q_label_distribution,
    "column_summary": q_column_summary,
    "ngram_counts": q_ngram_counts,
    "vocab_topk": q_vocab_topk,
    "tfidf": q_tfidf,
    "tfidf_windows": q_tfidf_windows,
    "scaled_metadata": q_scaled_metadata,
    "scaled_window_metadata": q_scaled_window_metadata,
    "stratified_split": q_stratified_split,
    "confusion": q_confusion,
    "class_report": q_class_report,
    "roc_auc": q_roc_auc,
    "contamination_threshold": q_contamination_threshold,
    "top_windows": q_top_windows,
    "evaluate_windows": q_evaluate_windows,
    "isolation_forest": q_isolation_forest,
    "robust_cov": q_robust_cov,
    "lof": q_lof,
    "robust_cov_features": q_robust_cov_features,
    "lof_features": q_lof_features,
    "lof_embeddings": q_lof_embeddings,
    "isolation_forest_embeddings": q_isolation_forest_embeddings,
    "logreg": q_logreg,
    "boosted": q_boosted,
    "token_patterns": q_token_patterns,
    "templates": q_templates,
    "stream_time_windows": q_stream_time_windows,
    "stream_block_sessions": q_stream_block_sessions,
    "sequence_examples": q_sequence_examples,
    "score_range": q_score_range,
    "label_csv": q_label_csv,
    "block_dataset_roundtrip": q_block_dataset_roundtrip,
    "block_sequences_sliced": q_block_sequences_sliced,
    "count_windows_sliced": q_count_windows_sliced,
    "ngram_counts_sliced": q_ngram_counts_sliced,
    "stratified_split_rare": q_stratified_split_rare,
    "text_parse": q_text_parse,
    "text_max_lines": q_text_max_lines,
    "text_yymmdd": q_text_yymmdd,
    "text_all_blocks": q_text_all_blocks,
    "labels_last_wins": q_labels_last_wins,
    "window_dataset_roundtrip": q_window_dataset_roundtrip,
    "stream_templates": q_stream_templates,
    "stream_scores": q_stream_scores,
    "tfidf_unbounded": q_tfidf_unbounded,
    "saved_features": q_saved_features,
    "feature_vectors": q_feature_vectors,
    "logreg_coefficients": q_logreg_coefficients,
    "predictions": q_predictions,
    "training_stats": q_training_stats,
    "block_sequences_pieces": q_block_sequences_pieces,
    "block_training_pieces": q_block_training_pieces,
    "mahalanobis_once": q_mahalanobis_once,
    "robust_cov_embeddings": q_robust_cov_embeddings,
    "lof_leaves": q_lof_leaves,
    "lof_projected": q_lof_projected,
}
