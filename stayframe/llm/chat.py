"""Chat formatting of reply trees.

Messages name their parent; self-joins that double their reach each time enumerate every root-to-leaf path,
branches are ranked by score, and each chosen path becomes one formatted conversation with its loss mask.

Template: a turn is `<s>` role `[INST]` text `[/INST]</s>`. In roles and texts a backslash is written as two, and
the first character of a control string (`<s>`, `</s>`, `[INST]`, `[/INST]`) as `\\l` for `<` or `\\b` for `[`, so that no
control string is left inside and `unescaped` restores every text exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, written

#: Turns that are numbered in one go.
TURNS = 1024
TURN = r"(?s)<s>(.*?)\[INST\](.*?)\[/INST\]</s>"


def escaped(text: Column) -> Column:
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    angles = F.regexp_replace(doubled, r"<(?=/?s>)", r"\\l")
    return F.regexp_replace(angles, r"\[(?=/?INST\])", r"\\b")


def unescaped(text: Column) -> Column:
    """Undoes `escaped`: the pieces between double backslashes can't hold one, so each is restored alone."""
    pieces = F.split(text, r"\\\\", -1)
    return F.array_join(F.transform(pieces, lambda x: F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("["))), "\\")


def root_to_leaf_paths(messages: DataFrame) -> DataFrame:
    """(leaf_id, node_id, above) for each node on each root-to-leaf path of messages (node_id, parent_id), above
    being its distance from the leaf.

    Round k joins the paths so far to the ancestors 2^k up, so a tree of depth d takes log2(d) rounds. node_id
    must be unique; a parent that doesn't exist makes its child a root; null node ids are left out, and so is every node on a
    cycle or below one, which no root leads to. An empty table gives no rows. A popular ancestor is a skewed join key,
    which Spark splits.
    """
    nodes = messages.where("node_id IS NOT NULL").select("node_id", "parent_id")
    known = nodes.select(F.col("node_id").alias("parent_id"))
    up = written(nodes.join(known, "parent_id", "left_semi").select("node_id", F.col("parent_id").alias("anc_id")), "up")
    leaves = nodes.join(up.select(F.col("anc_id").alias("node_id")), "node_id", "left_anti")
    paths = leaves.select(F.col("node_id").alias("leaf_id"), "node_id", F.lit(0).cast("long").alias("above"))
    reach, left, before = 1, up.count(), None
    # up holds the nodes that have an ancestor `reach` up. Every depth up to the deepest occurs in a tree, so a round that
    # loses no node leaves only those that have ancestors without end
    while left and left != before:
        higher = paths.join(up, "node_id").select("leaf_id", F.col("anc_id").alias("node_id"), (F.col("above") + reach).alias("above"))
        paths = written(paths.unionByName(higher), "paths")
        top = up.select(F.col("node_id").alias("anc_id"), F.col("anc_id").alias("next_id"))
        up = written(up.join(top, "anc_id").select("node_id", F.col("next_id").alias("anc_id")), "up")
        reach, left, before = 2 * reach, up.count(), left
    return paths.join(up.select(F.col("node_id").alias("leaf_id")), "leaf_id", "left_anti") if left else paths


def ranked_branches(messages: DataFrame, paths: DataFrame) -> DataFrame:
    """(leaf_id, root_id, branch_score, branch_rank): branches of a root by falling mean message score, then by
    length (longer first) and leaf. Null scores count as 0."""
    scores = messages.select("node_id", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    branches = (
        paths.join(scores, "node_id")
        .groupBy("leaf_id")
        .agg(F.avg("score").alias("branch_score"), F.max("above").alias("depth"), F.max_by("node_id", "above").alias("root_id"))
    )
    order = Window.partitionBy("root_id").orderBy(F.desc("branch_score"), F.desc("depth"), "leaf_id")
    return branches.select("leaf_id", "root_id", "branch_score", F.row_number().over(order).alias("branch_rank"))


def format_reply_trees(messages: DataFrame, *, branches: int = 1) -> DataFrame:
    """One conversation for each chosen path of messages (node_id, parent_id, role, text, score; more columns are
    ignored): leaf_id, root_id, branch_rank, n_turns, formatted, loss_spans (start from 1 and length, in code points of
    formatted, of each assistant text).

    The best `branches` paths of every root are chosen. Null roles and texts count as empty. Repeated node ids aren't allowed;
    cycles are left out. An empty table gives no rows. A conversation is one row of the result, so only the turns of one chosen path
    meet in a task.
    """
    paths = root_to_leaf_paths(messages)
    chosen = ranked_branches(messages, paths).where(F.col("branch_rank") <= branches)
    turn = messages.select("node_id", escaped(F.coalesce("role", F.lit(""))).alias("role"), escaped(F.coalesce("text", F.lit(""))).alias("text"))
    turns = (
        paths.join(chosen, "leaf_id")
        .join(turn, "node_id")
        .groupBy("leaf_id", "root_id", "branch_rank")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("above")).alias("place"), "role", "text"))).alias("turns"))
    )
    spans = F.expr(
        """aggregate(turns, named_struct('at', 1, 'spans', CAST(array() AS array<struct<start:int,length:int>>)),
            (s, x) -> named_struct('at', s.at + length(x.role) + length(x.text) + 20, 'spans', IF(x.role = 'assistant',
                concat(s.spans, array(named_struct('start', s.at + length(x.role) + 9, 'length', length(x.text)))), s.spans)),
            s -> s.spans)"""
    )
    rendered = F.transform("turns", lambda x: F.concat(F.lit("<s>"), x["role"], F.lit("[INST]"), x["text"], F.lit("[/INST]</s>")))
    return turns.select(
        "leaf_id", "root_id", "branch_rank", F.size("turns").cast("long").alias("n_turns"), F.array_join(rendered, "").alias("formatted"), spans.alias("loss_spans")
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds `roles` and `texts` of all turns, and `loss_texts` under the mask, all read from the output."""
    loss = F.transform("loss_spans", lambda x: unescaped(F.substring(F.col("formatted"), x["start"], x["length"])))
    return formatted.withColumns(
        {
            "roles": F.transform(F.regexp_extract_all("formatted", F.lit(TURN), 1), unescaped),
            "texts": F.transform(F.regexp_extract_all("formatted", F.lit(TURN), 2), unescaped),
            "loss_texts": loss,
        }
    )


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as reply trees: each turn answers the one before it. Rows that share a turn
    follow each other in the order of role and text, null turns come first, null conv_ids are one conversation; the score is null.

    A node is (conv_id, number). Turns are numbered in spans of TURNS turns and from the rows of the spans before, so that a long
    conversation is dealt out over tasks.
    """
    spans = conversations.select("conv_id", "turn", "role", "text", F.floor(F.col("turn") / TURNS).alias("span"))
    earlier = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    sizes = spans.groupBy("conv_id", "span").agg(F.count(F.lit(1)).alias("rows")).withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    sizes = sizes.select(F.col("conv_id").alias("of_conv"), F.col("span").alias("of_span"), "before")
    order = Window.partitionBy("conv_id", "span").orderBy("turn", "role", "text")
    placed = spans.withColumn("n", F.row_number().over(order)).join(sizes, F.col("conv_id").eqNullSafe(F.col("of_conv")) & F.col("span").eqNullSafe(F.col("of_span")))
    numbered = placed.withColumn("n", F.col("n") + F.col("before"))
    node = lambda n: F.struct("conv_id", n.alias("n"))
    parent = F.when(F.col("n") > 1, node(F.col("n") - 1))
    return numbered.select("conv_id", node(F.col("n")).alias("node_id"), parent.alias("parent_id"), "role", "text", F.lit(None).cast("double").alias("score"))


def op6_format_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    messages = written(conversation_messages(rows), "messages")
    back = read_back(format_reply_trees(messages))
    pairs = F.transform(F.arrays_zip("roles", "texts"), lambda x: F.concat(x["roles"], F.lit("\n"), x["texts"], F.lit("\n")))
    loss = F.array_join("loss_texts", "")
    return back.select(
        F.col("root_id.conv_id").alias("conv_id"),
        F.size("roles").cast("long").alias("n_turns"),
        F.sha2(F.array_join(pairs, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP6_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), longer AS (
  SELECT *, length(replace(text, '\', '\\')) + (length(regexp_replace(text, '(<)(/?s>)', '\1\1\2', 'g')) - length(text))
    + (length(regexp_replace(text, '(\[)(/?INST\])', '\1\1\2', 'g')) - length(text)) AS written,
    length(replace(role, '\', '\\')) + (length(regexp_replace(role, '(<)(/?s>)', '\1\1\2', 'g')) - length(role))
    + (length(regexp_replace(role, '(\[)(/?INST\])', '\1\1\2', 'g')) - length(role)) AS named
  FROM rows
), said AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS all_turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss, sum(named + written + 20) AS formatted
  FROM longer GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(all_turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted::BIGINT AS formatted_chars FROM said
"""
