"""Conversational behaviour of a reply, given the turn before it.

Each behaviour has one of four outcomes and never a boolean: 'fired', 'quiet', 'abstained' (what
it needs to know is unknown) or 'suppressed' (what it would charge was asked for).

Defined results: without a user turn the behaviours that compare with it are unjudged; null and
empty replies are quiet throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosescan.functions import text as T
from prosescan.plans import lexicon, patterns

# Confidence of each behaviour when it fires.
CONFIDENCE = {"chat.over_agreement": 0.65, "chat.unsolicited_advice": 0.7, "chat.auto_summary": 0.8, "chat.unsolicited_offer": 0.85, "chat.over_completeness": 0.7, "chat.explains_obvious": 0.55, "chat.forced_positivity": 0.7, "chat.mechanical_empathy": 0.8, "chat.unrequested_background": 0.65}
MIRRORED, MARKED = 0.7, 0.75
OVERLAP, COVERAGE, LEAST_TOKENS = 0.6, 0.5, 3
SHORT_TURN, SENTENCES, RATIO = 120, 4, 3


def advice_permission(explicit: Column, solution: Column, kinds: Column) -> Column:
    """'granted', 'absent' or 'unknown': what is stated, else what the solution level says, else what was asked for."""
    stated = F.when(explicit.isin("granted", "absent", "unknown"), explicit)
    level = F.when(solution == "HIGH", "granted").when(solution == "LOW", "absent").when(solution.isNotNull(), "unknown")
    asked = F.when(F.array_contains(F.transform(kinds, F.lower), "advice"), "granted")
    return F.coalesce(stated, level, asked, F.lit("unknown"))


def with_previous_turn(turns: DataFrame, conversation: str, position: str, text: str, role: str, user: str = "user") -> DataFrame:
    """``turns`` with ``user_turn``: the text just before, if a user wrote it."""
    w = Window.partitionBy(conversation).orderBy(position)
    return turns.withColumn("user_turn", F.when(F.lag(role).over(w) == user, F.lag(text).over(w)))


def content_tokens(text: Column) -> Column:
    """Distinct tokens of more than one character."""
    return F.array_distinct(F.filter(T.tokens(text), lambda t: F.char_length(t) > 1))


def mirroring(reply: Column, user: Column) -> dict[str, Column]:
    """Tokens that the reply's first two sentences share with the user's turn."""
    mine, theirs = content_tokens(F.array_join(F.slice(T.sentences(reply), 1, 2), " ")), content_tokens(user)
    return {"n_shared": F.size(F.array_intersect(mine, theirs)), "n_opening": F.size(mine), "n_user": F.size(theirs)}


def has_marker(reply: Column, smell: str) -> Column:
    """Whether a reply holds one of a behaviour's markers in its own language."""
    by_lang = {lang: "|".join(patterns.marker(m) for m in ms) for lang, ms in lexicon.markers()[smell].items()}
    return F.when(T.mostly_cjk(reply, 0.3), reply.rlike(by_lang["zh"])).otherwise(reply.rlike("(?i)" + by_lang["en"]))


def _marked(smell: str, text: Column) -> Column:
    """``has_marker`` for a row that has low and zh: a plain search spares nearly all regular expressions."""
    out = {}
    for lang, ms in lexicon.markers()[smell].items():
        bare = [m.removeprefix("^").strip() for m in ms]
        near = F.lit(False)
        for b in bare:
            near = near | F.contains(F.col("low"), F.lit(b))
        out[lang] = near & text.rlike(("(?i)" if lang == "en" else "") + "|".join(patterns.marker(m) for m in ms))
    return F.when(F.col("zh"), out["zh"]).otherwise(out["en"])


def with_outcomes(rows: DataFrame, text: Column, user: Column, permission: Column, solution: Column | None = None, kinds: Column | None = None) -> DataFrame:
    """Rows with ``outcomes``: an array of (rule_id, outcome, severity, confidence, scoring), one for each behaviour. ``text`` must not be null."""
    none = F.array().cast("array<string>")
    asked = F.coalesce(kinds, none) if kinds is not None else none
    allowed = advice_permission(permission, solution if solution is not None else F.lit(None).cast("string"), asked)
    # what several behaviours look at is computed once, only where there is a turn to compare with
    compared = F.struct(*[c.alias(n) for n, c in mirroring(text, user).items()], F.size(T.sentences(text)).alias("said"), F.greatest(F.lit(1), F.size(T.sentences(user))).alias("turn"))
    rows = rows.withColumns({"low": F.lower(text), "zh": T.mostly_cjk(text, 0.3), "m": F.when(user.isNotNull(), compared), "_allowed": allowed})
    m, allowed = F.col("m"), F.col("_allowed")
    mirrored = (m["n_user"] >= LEAST_TOKENS) & (F.try_divide(m["n_shared"], m["n_opening"]) >= OVERLAP) & (F.try_divide(m["n_shared"], m["n_user"]) >= COVERAGE)
    said, turn = m["said"], m["turn"]
    found = []
    for smell, (severity, scoring) in lexicon.smells().items():
        hit = F.coalesce(_marked(smell, text), F.lit(False))
        sure = F.lit(CONFIDENCE.get(smell))
        if smell == "chat.mirrors_user":
            sure = F.when(F.coalesce(mirrored, F.lit(False)), MIRRORED).otherwise(MARKED)
            outcome = F.when(user.isNull(), "unjudged").when(F.coalesce(mirrored, F.lit(False)) | hit, "fired")
        elif smell == "chat.over_completeness":
            outcome = F.when(user.isNull(), "unjudged").when((F.char_length(user) <= SHORT_TURN) & (said > SENTENCES) & (said / turn >= RATIO), "fired")
        elif smell == "chat.unsolicited_advice":
            outcome = F.when(hit, F.when(allowed == "absent", "fired").when(allowed == "granted", "suppressed").otherwise("abstained"))
        elif smell == "chat.unrequested_background":
            outcome = F.when(hit & ~F.array_contains(asked, "background"), "fired")
        else:
            outcome = F.when(hit, "fired")
        found.append(F.struct(F.lit(smell).alias("rule_id"), F.coalesce(outcome, F.lit("quiet")).alias("outcome"), F.lit(severity).alias("severity"), sure.cast("double").alias("confidence"), F.lit(scoring).alias("scoring")))
    return rows.withColumn("outcomes", F.array(*found)).drop("low", "zh", "m", "_allowed")


def smell_findings(outcomes: Column) -> Column:
    """The behaviours that fired, as findings of a scan."""
    spans = F.array().cast("array<struct<start:int,end:int,text:string>>")
    fired = F.filter(outcomes, lambda x: x["outcome"] == "fired")
    return F.transform(fired, lambda x: F.struct(x["rule_id"].alias("rule_id"), F.lit("assistant.smells").alias("detector_id"), F.lit("assistant").alias("family"), x["severity"].alias("severity"), x["confidence"].alias("confidence"), spans.alias("evidence")))


def outcomes(replies: DataFrame, reply_id: str, reply: str, user_turn: str = "user_turn", permission: str = "advice_permission", solution: str | None = None, kinds: str | None = None) -> DataFrame:
    """(reply_id, rule_id, outcome, severity, confidence, scoring) for every reply and behaviour."""
    rows = replies.select(
        F.col(reply_id).alias("reply_id"), F.coalesce(F.col(reply), F.lit("")).alias("text"), F.col(user_turn).alias("user"), F.col(permission).alias("permission"),
        (F.col(solution) if solution else F.lit(None).cast("string")).alias("solution"), (F.col(kinds) if kinds else F.lit(None).cast("array<string>")).alias("kinds"),
    )
    c = F.col
    return with_outcomes(rows, c("text"), c("user"), c("permission"), c("solution"), c("kinds")).select("reply_id", F.inline(T.each("outcomes")))


def row_score(outcomes: Column, budget: float = 3.0) -> Column:
    """struct<behavior_score, judged, abstained, suppressed, unjudged, fired> of one reply: only the discriminating behaviours are charged, by weights of four decimals."""
    charged = F.aggregate(outcomes, F.lit(0.0), lambda a, x: a + F.when((x["outcome"] == "fired") & (x["scoring"] == "discriminating"), F.round(x["severity"] / 5 * x["confidence"], 4)).otherwise(0.0))
    count = lambda o: F.size(F.filter(outcomes, lambda x: x["outcome"] == o))
    n = {o: count(o) for o in ("abstained", "suppressed", "unjudged", "fired")}
    judged = F.size(outcomes) - n["unjudged"] - n["abstained"]
    return F.struct(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - charged / budget)).alias("behavior_score"), judged.alias("judged"), *[c.alias(o) for o, c in n.items()])


def behavior_scores(replies: DataFrame, reply_id: str, reply: str, user_turn: str = "user_turn", permission: str = "advice_permission", solution: str | None = None, kinds: str | None = None) -> DataFrame:
    """(reply_id, behavior_score, judged, abstained, suppressed, unjudged, fired) of every reply; nothing is grouped."""
    none = lambda kind: F.lit(None).cast(kind)
    c = lambda name, kind="string": F.col(name) if name else none(kind)
    rows = replies.select(F.col(reply_id).alias("reply_id"), F.coalesce(F.col(reply), F.lit("")).alias("text"), c(user_turn).alias("user"), c(permission).alias("permission"), c(solution).alias("solution"), c(kinds, "array<string>").alias("kinds"))
    rows = with_outcomes(rows, *(F.col(x) for x in ("text", "user", "permission", "solution", "kinds")))
    return rows.select("reply_id", row_score(F.col("outcomes")).alias("s")).select("reply_id", "s.*")


def regression(before: Column, after: Column, tolerance: float = 0.05) -> Column:
    """Whether a score fell by more than the tolerance."""
    return after - before < -tolerance
