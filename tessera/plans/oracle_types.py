"""Floating-point output columns of each oracle query (from DuckDB DESCRIBE).

Both engines round these to 6 decimals, so the value hash does not depend on
the summation order of either engine. tests/test_oracle.py checks this table
against the SQL.
"""

ROUND_COLS = {
    'abs_sq_error': ['mae', 'mse'],
    'accuracy': ['accuracy'],
    'average_rank': ['rank'],
    'binary_f1_grid': ['f1'],
    'carry_header': ['header_value'],
    'class_report': ['precision', 'recall', 'f1'],
    'compute_metric': ['precision', 'recall', 'f1'],
    'cosine_mse': ['cosine_mse'],
    'cosine_paired': ['cosine'],
    'encode_text': ['norm'],
    'epoch_summary': ['train_loss', 'valid_loss'],
    'eval_matrix': ['accuracy', 'macro_f1', 'weighted_f1'],
    'first_pool': ['value'],
    'layer_features': ['norm'],
    'mean_over_seeds': ['mean_f1', 'std_f1'],
    'mean_pool': ['value'],
    'micro_scores': ['micro_precision', 'micro_recall', 'micro_f1'],
    'pair_similarity_scores': ['pearson', 'spearman'],
    'predict_similarity': ['similarity'],
    'scale_score': ['scaled'],
    'segment_by_header': ['total_value'],
    'softmax_expected': ['score'],
    'sorted_pairs': ['score_sorted', 'cosine_sorted'],
    'spearman': ['spearman'],
    'weighted_f1': ['weighted_f1'],
    'write_metrics': ['accuracy'],
}

DECIMALS = 6


def round_sql(key: str, sql: str) -> str:
    """Wrap an oracle query so its floating columns are rounded (and -0.0 folded to 0.0)."""
    cols = ROUND_COLS.get(key)
    if not cols:
        return sql
    repl = ", ".join(f"CAST(round({c}, {DECIMALS}) AS DOUBLE) + 0.0 AS {c}" for c in cols)
    return f"SELECT * REPLACE ({repl}) FROM (\n{sql}\n) AS oracle_q"


def round_frame(df):
    """Round every double/float column of a Spark result the same way."""
    from pyspark.sql import functions as F
    cols = {f.name: (F.round(F.col(f.name).cast("double"), DECIMALS) + F.lit(0.0))
            for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.withColumns(cols) if cols else df
