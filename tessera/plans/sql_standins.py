"""The stand-in corpora of :mod:`tessera.plans.standins` written as SQL CTEs.

Used by the independent oracle (DuckDB over the same Parquet tables): each
oracle query is ``WITH <needed CTEs> SELECT ...``. Kept separate from the
Spark code on purpose - the two must agree only on results.
"""

from __future__ import annotations

from tessera.plans.standins import EVENT_SHIFT, LID_RULE, MODELS, SENTIMENT_RULE, TAG_RULE, TURN_BITS


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def words_sql(x: str) -> str:
    return rf"list_filter(string_split(trim(regexp_replace({x}, '[\t\n\r ]+', ' ', 'g')), ' '), lambda w: w <> '')"


def pick_sql(values, n: str) -> str:
    return f"{_list(values)}[CAST(({n}) % {len(values)} AS INTEGER) + 1]"


def tag_sql(w: str) -> str:
    return pick_sql(TAG_RULE, f"length({w})")


def lid_sql(w: str) -> str:
    return pick_sql(LID_RULE, f"length({w})")


_SHIFT_CASE = "CASE " + " ".join(f"WHEN {{g}} = '{k}' THEN '{v}'" for k, v in EVENT_SHIFT.items()) + " END"

SID_SQL = f"(CAST({{c}} AS BIGINT) * {1 << TURN_BITS} + turn)"

CTES: dict[str, str] = {
    "conv_turns": f"""
conv_turns AS (
  SELECT conv_id, turn, role, words,
         CAST(coalesce(sum(len(words)) OVER (PARTITION BY conv_id ORDER BY turn
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off
  FROM (SELECT conv_id, turn, role, {words_sql('text')} AS words FROM conversations) c)""",
    "conv_tokens": """
conv_tokens AS (
  SELECT conv_id AS sent_id, CAST(off + i AS BIGINT) AS pos, word, role AS label, turn, i AS wpos
  FROM (SELECT conv_id, turn, role, off, unnest(range(len(words))) AS i, unnest(words) AS word
        FROM conv_turns) u)""",
    "doc_tokens": f"""
doc_tokens AS (
  SELECT doc_id AS sent_id, CAST(i AS BIGINT) AS pos, word, {tag_sql('word')} AS tag
  FROM (SELECT doc_id, unnest(range(len(words))) AS i, unnest(words) AS word
        FROM (SELECT doc_id, {words_sql('text')} AS words FROM documents) d) u)""",
    "label_texts": f"""
label_texts AS (
  SELECT doc_id, text, source, n_chars, {pick_sql(SENTIMENT_RULE, 'doc_id')} AS sentiment,
         {pick_sql(LID_RULE, 'doc_id')} AS lang_label
  FROM documents)""",
    "event_preds": f"""
event_preds AS (
  SELECT event_id, event_type AS gold,
         CASE WHEN event_id % 3 = 0 OR event_type = 'signup' THEN {_SHIFT_CASE.format(g='event_type')}
              ELSE event_type END AS pred
  FROM events)""",
    "model_grid": f"""
model_grid AS (
  SELECT {pick_sql(MODELS, 'm')} AS model, CAST(layer AS INTEGER) AS layer, CAST(seed AS INTEGER) AS seed,
         event_id, gold,
         CASE WHEN (event_id + layer * 7 + seed * 3 + m) % (m + 3) = 0 THEN {_SHIFT_CASE.format(g='gold')}
              ELSE pred END AS pred
  FROM (SELECT ep.*, g // 20 AS m, (g % 20) // 5 + 1 AS layer, g % 5 AS seed
        FROM event_preds ep, (SELECT unnest(range(60)) AS g) gg) x)""",
    "label_preds": """
label_preds AS (
  SELECT l.doc_id, CAST(l.quality AS INTEGER) AS gold, CAST(d.n_chars > 500 AS INTEGER) AS pred
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)""",
    "epoch_events": """
epoch_events AS (
  SELECT CAST(ts AS DATE) AS epoch, CASE WHEN event_id % 10 < 8 THEN 'train' ELSE 'valid' END AS split,
         value AS loss
  FROM events)""",
    "emb_pairs": """
emb_pairs AS (
  SELECT a.vec_id AS pair_id, a.embedding AS v1, b.embedding AS v2,
         CASE WHEN a.label = b.label THEN 5.0 ELSE CAST(abs(a.label - b.label) % 5 AS DOUBLE) END AS score
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)""",
    "graded_pairs": """
graded_pairs AS (
  SELECT a.vec_id AS pair_id, CAST(b.vec_id - a.vec_id AS INTEGER) AS step FROM embeddings a JOIN embeddings b ON b.vec_id BETWEEN a.vec_id + 1 AND a.vec_id + 8)""",
    "emb_logits": """
emb_logits AS (
  SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS logits, label, CAST(label % 3 AS INTEGER) AS gold
  FROM embeddings)""",
    "emb_soft": """
emb_soft AS (
  SELECT id, [coalesce(list_sum(list_transform(range(1, len(logits) + 1), lambda i: CASE WHEN (i - 1) % 3 = 0 THEN logits[i] ELSE 0.0 END)), 0.0),
              coalesce(list_sum(list_transform(range(1, len(logits) + 1), lambda i: CASE WHEN (i - 1) % 3 = 1 THEN logits[i] ELSE 0.0 END)), 0.0),
              coalesce(list_sum(list_transform(range(1, len(logits) + 1), lambda i: CASE WHEN (i - 1) % 3 = 2 THEN logits[i] ELSE 0.0 END)), 0.0)] AS logits, gold
  FROM emb_logits)""",
    "emb_tokens": """
emb_tokens AS (
  SELECT CAST(vec_id // 5 AS BIGINT) AS sent_id, CAST(vec_id % 5 AS INTEGER) AS pos, embedding AS vec,
         CASE WHEN vec_id % 7 = 0 THEN 0 ELSE 1 END AS mask, label
  FROM embeddings)""",
    "order_graphs": """
order_graphs AS (
  SELECT l_orderkey AS graph_id, CAST(l_suppkey AS BIGINT) AS u, CAST(l_partkey AS BIGINT) AS v,
         CAST(min(l_linenumber) AS BIGINT) AS pos
  FROM lineitem WHERE l_suppkey <> l_partkey GROUP BY ALL)""",
    "customer_graphs": """
customer_graphs AS (
  SELECT o_custkey AS graph_id, CAST(o_orderkey AS BIGINT) AS u, -CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS v
  FROM orders)""",
    "graph_pairs": """
graph_pairs AS (
  SELECT a.graph_id AS g1, b.graph_id AS g2
  FROM (SELECT DISTINCT graph_id FROM order_graphs) a
  JOIN (SELECT DISTINCT graph_id FROM order_graphs) b ON b.graph_id = a.graph_id + 1)""",
}

DEPENDS = {
    "conv_tokens": ["conv_turns"],
    "model_grid": ["event_preds"],
    "graph_pairs": ["order_graphs"],
    "emb_soft": ["emb_logits"],
}


def with_ctes(*names: str, extra: str = "") -> str:
    """``WITH`` clause holding the named stand-ins (and their dependencies)."""
    order: list[str] = []

    def add(n):
        for dep in DEPENDS.get(n, []):
            add(dep)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [CTES[n].strip() for n in order]
    if extra:
        parts.append(extra.strip())
    return "WITH " + ",\n".join(parts) + "\n"
