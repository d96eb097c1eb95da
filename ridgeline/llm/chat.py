"""Chat formatting: a finite-state machine over roles and a declarative template.

A template names, for each role, the text before and after its turns and whether
the turn is trained on; its transitions say which role may follow in which state.
The machine runs as one fold over each conversation's sorted turns, inside the
JVM; turns become segments (opening, content, closing), each with its loss flag.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import read


@dataclass(frozen=True)
class Role:
    before: str
    after: str
    #: Whether content and closing are trained on; what comes before never is.
    loss: bool = False


@dataclass(frozen=True)
class Template:
    roles: dict[str, Role]
    #: (state, role) -> state; what isn't listed is an error.
    transitions: dict[tuple[str, str], str]
    start: str = "start"
    #: States in which a conversation may end. Turns after the last one are left out.
    accepting: frozenset[str] = frozenset({"assistant"})
    #: Replacements in the content, so that no text can pose as markup.
    escapes: tuple[tuple[str, str], ...] = field(default=(("<|", "< |"),))


CHATML = Template(
    roles={r: Role(f"<|im_start|>{r}\n", "<|im_end|>\n", r == "assistant") for r in ("system", "user", "assistant", "tool")},
    transitions={
        ("start", "system"): "system",
        ("start", "user"): "user",
        ("system", "user"): "user",
        ("user", "assistant"): "assistant",
        ("assistant", "user"): "user",
        ("assistant", "tool"): "tool",
        ("tool", "tool"): "tool",
        ("tool", "assistant"): "assistant",
    },
)


def _next(template: Template, state: Column, role: Column) -> Column:
    out = F.lit(None).cast("string")
    for (s, r), to in template.transitions.items():
        out = F.when((state == s) & (role == r), F.lit(to)).otherwise(out)
    return out


def chat_segments(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """One row per segment: conv_id, segment, turn, role, text, loss, error.

    A conversation is refused as a whole, with one row that has only conv_id,
    turn, role and error, if a turn has no number ("no turn number"), a number
    occurs again ("repeated turn"), a role is null or can't follow in the state
    reached ("<role> in <state>"; the first such turn counts), or no accepting state is
    reached ("unfinished"). Turns after the last accepting state are left out.
    A null text is empty content; an empty content has a segment like any other.
    Rows without conv_id belong to no conversation and are left out; extra columns
    are ignored; an empty table gives no row.
    """
    own = turns.where("conv_id is not null").groupBy(F.col("conv_id").alias("conv_id")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("null")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))).alias("turns")
    )
    first = F.struct(
        F.lit(template.start).alias("state"), F.lit(0).alias("n"), F.lit(0).alias("last"),
        F.lit(None).cast("long").alias("bad_turn"), F.lit(None).cast("string").alias("bad_role"),
        F.lit(None).cast("string").alias("error"), F.lit(None).cast("long").alias("previous"),
    )

    def step(s: Column, t: Column) -> Column:
        to = _next(template, s["state"], t["role"])
        error = (
            F.when(t["turn"].isNull(), "no turn number")
            .when(t["turn"] == s["previous"], "repeated turn")
            .when(to.isNull(), F.concat(t["role"], F.lit(" in "), s["state"]))
        )
        bad, failed = s["error"].isNotNull(), error.isNotNull()
        return F.struct(
            F.coalesce(to, s["state"]).alias("state"),
            (s["n"] + 1).alias("n"),
            F.when(to.isin(*sorted(template.accepting)), s["n"] + 1).otherwise(s["last"]).alias("last"),
            F.when(bad, s["bad_turn"]).when(failed, t["turn"]).alias("bad_turn"),
            F.when(bad, s["bad_role"]).when(failed, t["role"]).alias("bad_role"),
            F.coalesce(s["error"], error).alias("error"),
            t["turn"].alias("previous"),
        )

    run = own.select("conv_id", "turns", F.aggregate("turns", first, step).alias("end"))
    run = run.withColumn("error", F.coalesce(F.col("end.error"), F.when(F.col("end.last") == 0, "unfinished")))
    text = F.col("t.text")
    for a, b in template.escapes:
        text = F.replace(text, F.lit(a), F.lit(b))
    role = F.col("t.role")

    def by_role(what) -> Column:
        out = F.lit(None)
        for name, r in template.roles.items():
            out = F.when(role == name, F.lit(what(r))).otherwise(out)
        return out

    loss = F.coalesce(by_role(lambda r: r.loss), F.lit(False))
    parts = F.array(
        F.struct(F.coalesce(by_role(lambda r: r.before), F.lit("")).alias("text"), F.lit(False).alias("loss")),
        F.struct(text.alias("text"), loss.alias("loss")),
        F.struct(F.coalesce(by_role(lambda r: r.after), F.lit("")).alias("text"), loss.alias("loss")),
    )
    # Either the turns up to the last accepting state, each in three parts, or one row that says what is wrong: one pass for both.
    fine = F.col("error").isNull()
    refusal = F.array(F.struct(F.col("end.bad_turn").alias("turn"), F.col("end.bad_role").alias("role"), F.lit(None).cast("string").alias("text")))
    nothing = F.array(F.struct(F.lit(None).cast("string").alias("text"), F.lit(None).cast("boolean").alias("loss")))
    return (
        run.select("conv_id", "error", F.posexplode(F.when(fine, F.slice("turns", F.lit(1), F.col("end.last"))).otherwise(refusal)).alias("i", "t"))
        .select("conv_id", "error", "i", "t.turn", role.alias("role"), F.posexplode(F.when(fine, parts).otherwise(nothing)).alias("j", "p"))
        .select("conv_id", F.when(fine, F.col("i") * 3 + F.col("j")).alias("segment"), "turn", "role", "p.text", "p.loss", "error")
    )


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_segments(read(spark, sf_dir, "conversations"))


_ALLOWED = ", ".join(f"('{s}', '{r}')" for s, r in CHATML.transitions)
QUERIES = {"op3_chat_formatting": op3_chat_formatting}
SQL = {
    "op3_chat_formatting": f"""
WITH turns AS (
    SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, 'null') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'null'), coalesce(text, '')) AS i
    FROM conversations WHERE conv_id IS NOT NULL
), stated AS (
    SELECT *, lag(turn) OVER w AS previous, coalesce(lag(role) OVER w, 'start') AS state FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY i)
), judged AS (
    SELECT *, CASE WHEN turn IS NULL THEN 'no turn number' WHEN turn = previous THEN 'repeated turn'
                   WHEN (state, role) NOT IN ({_ALLOWED}) THEN role || ' in ' || state END AS wrong
    FROM stated
), ends AS (
    SELECT conv_id, min(i) FILTER (wrong IS NOT NULL) AS bad, coalesce(max(i) FILTER (role = 'assistant'), 0) AS last FROM judged GROUP BY conv_id
), parts AS (
    SELECT j.conv_id, CAST((j.i - 1) * 3 + p.k AS INTEGER) AS segment, j.turn, j.role,
           CASE p.k WHEN 0 THEN '<|im_start|>' || j.role || chr(10) WHEN 1 THEN replace(j.text, '<|', '< |') ELSE '<|im_end|>' || chr(10) END AS text,
           p.k > 0 AND j.role = 'assistant' AS loss, CAST(NULL AS VARCHAR) AS error
    FROM judged j JOIN ends e USING (conv_id), (VALUES (0), (1), (2)) p(k)
    WHERE e.bad IS NULL AND j.i <= e.last
)
SELECT * FROM parts
UNION ALL
SELECT e.conv_id, NULL, j.turn, j.role, NULL, NULL, coalesce(j.wrong, 'unfinished')
FROM ends e LEFT JOIN judged j ON j.conv_id = e.conv_id AND j.i = e.bad
WHERE e.bad IS NOT NULL OR e.last = 0
"""
}
