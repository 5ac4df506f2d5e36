"""URL filters: rules first, then a character language-model ratio, all in DataFrame functions.

The rules decide some URLs.  These train two smoothed variable-order Markov
models of characters, one of accepted and one of rejected URLs, over all rows.
A model mixes the orders 0 to ``ORDER`` by Witten-Bell smoothing: a context seen n
times with t different successors trusts its own counts by n / (n + t) and the
next shorter context by t / (n + t); unseen contexts pass on all their weight.

A URL that no rule decides is judged by the difference of its log-likelihoods
per character, against a threshold.  A fifth of the rule-decided URLs, by a digest of the text, trains
nothing: the threshold is calibrated, and the error measured, on these.

Nothing is broadcast but a bounded number of hot keys.  The probabilities of each order are built on
those of the order below, so a join of contexts meets no more rows a key than there are characters.  Windows such as
the start of a URL are in every row; they reach these by a broadcast (``skew.join_counted``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.llm.skew import join_counted
from driftloom.plans.lineage import cut

ORDER = 4
#: Of so many parts of the decided URLs one is held out.
FOLDS = 5
#: Texts for each task that cuts them into windows; few texts are dealt finer, to ``SPREAD`` tasks.
TEXTS, SPREAD = 20_000, 64
_START, _END = "\x02", "\x03"
_UPPER, _LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    def __str__(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1), _UPPER, _LOWERED)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def matched_rule(rules: list[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), or null."""
    found: Column | None = None
    for rule in sorted(rules, key=lambda r: (-len(str(r)), str(r))):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        value = F.struct(F.lit(str(rule)).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return F.lit(None).cast("struct<rule: string, verdict: string>") if found is None else found


def _windows(text: Column) -> Column:
    """Each character of ``text`` and its end, after the ``ORDER`` characters before it."""
    padded = F.concat(F.lit(_START * ORDER), text, F.lit(_END))
    return F.transform(F.sequence(F.lit(1), F.char_length(text) + 1), lambda i: F.substring(padded, i, F.lit(ORDER + 1)))


def held_out(text: Column) -> Column:
    """Whether a text is in the held-out part, by its digest."""
    return F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 8), 16, 10).cast("long") % FOLDS == 0


def window_scores(windows: DataFrame) -> DataFrame:
    """(window, score, rows): log p_allow - log p_block of each distinct window of ``windows(window, label, n)``, and how many rows have it.

    ``label`` is allow, block, or null for windows that only need a score; ``n`` is how often the row counts.
    """
    classes = ("allow", "block")
    counts = windows.groupBy("window").agg(*[F.sum(F.when(F.col("label") == c, F.col("n")).otherwise(0)).alias(c) for c in classes], F.count("*").alias("rows"))
    orders = [cut(counts.select(F.substring("window", 1, ORDER).alias("context"), F.substring("window", ORDER + 1, 1).alias("next"), *classes, "rows"))]
    for _ in range(ORDER):  # the same counts with ever shorter contexts
        shorter = orders[-1].groupBy(F.substring("context", 2, ORDER).alias("context"), "next").agg(*[F.sum(c).alias(c) for c in classes])
        orders.append(cut(shorter))
    known = None
    for k, grams in enumerate(reversed(orders)):
        within = Window.partitionBy("context")
        grams = grams.withColumns({f"all_{c}": F.sum(c).over(within) for c in classes} | {f"kinds_{c}": F.count_if(F.col(c) > 0).over(within) for c in classes})
        if known is None:
            grams = grams.withColumns({f"p_{c}": F.lit(1.0 / 256) for c in classes})
        else:
            grams = grams.withColumn("shorter", F.substring("context", 2, k)).join(known.withColumnRenamed("context", "shorter"), ["shorter", "next"]).drop("shorter")
        mixed = {c: F.when(F.col(f"all_{c}") > 0, (F.col(c) + F.col(f"kinds_{c}") * F.col(f"p_{c}")) / (F.col(f"all_{c}") + F.col(f"kinds_{c}"))).otherwise(F.col(f"p_{c}")) for c in classes}
        more = ["rows"] if k == ORDER else []
        known = grams.select("context", "next", *[mixed[c].alias(f"p_{c}") for c in classes], *more)
    return known.select(F.concat("context", "next").alias("window"), (F.log("p_allow") - F.log("p_block")).alias("score"), "rows")


def calibrate(decided: DataFrame) -> tuple[float, dict[str, float]]:
    """The threshold for the rows (label, held, n, score) of decided texts, and the part of each class's held-out URLs on its wrong side.

    The threshold lies between the classes' mean scores, weighed by their deviations, over the held-out rows; over all
    rows if those lack a class, and 0 if all do.
    """
    sums = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("score")).alias("s"), F.sum(F.col("n") * F.col("score") * F.col("score")).alias("s2")]
    own = [r.asDict() for r in decided.groupBy("label", "held").agg(*sums).collect()]  # four rows at most
    threshold = 0.0
    for rows in ([r for r in own if r["held"]], own):
        fit = {c: [sum(r[k] for r in rows if r["label"] == c) for k in ("n", "s", "s2")] for c in ("allow", "block")}
        if all(n for n, _, _ in fit.values()):
            mean = {c: s / n for c, (n, s, _) in fit.items()}
            spread = {c: max(s2 / n - mean[c] ** 2, 1e-12) ** 0.5 for c, (n, _, s2) in fit.items()}
            threshold = (mean["allow"] * spread["block"] + mean["block"] * spread["allow"]) / (spread["allow"] + spread["block"])
            break
    wrong = (F.col("label") == "allow") != (F.col("score") >= threshold)
    errors = decided.where("held").groupBy("label").agg((F.sum(F.when(wrong, F.col("n")).otherwise(0)) / F.sum("n")).alias("error")).collect()
    return threshold, {r["label"]: r["error"] for r in errors}


def scored_texts(ruled: DataFrame) -> DataFrame:
    """(text, label, held, n, score): the distinct host and path texts of ``ruled(host, path, label)`` with their scores."""
    texts = cut(ruled.groupBy(F.concat("host", "path").alias("text")).agg(F.max("label").alias("label"), F.count("*").alias("n")).withColumn("held", held_out(F.col("text"))))
    count = texts.count()
    spread = texts.repartition(max(-(-count // TEXTS), min(SPREAD, count // 500), 1))
    label = F.when(~F.col("held"), F.col("label")).alias("label")
    scores = cut(window_scores(spread.select(label, "n", F.explode(_windows(F.col("text"))).alias("window"))))
    total = scores.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    windows = spread.select("text", F.explode(_windows(F.col("text"))).alias("window"))
    score = join_counted(windows, scores, ["window"], "rows", total).groupBy("text").agg((F.sum("score") / F.count("*")).alias("score"))
    return cut(texts.join(score, "text"))


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score): every row of ``pages`` with its verdict, allow or block.

    ``score`` is the model's log-likelihood difference per character of host and path, higher for allow; the
    rule's verdict holds where a rule fits, else that of the score against the calibrated threshold.

    - A null URL or one without ``://`` has an empty host and path; the model judges the empty text.
    - A null id stays null; repeated rows are judged alike, each row by itself.
    - Where unlike hosts and paths make one text and rules judge them unlike, the text trains as block.
    - Without both allowed and blocked URLs the threshold is 0 and so is every tie: allow.
    - Very long URLs are used whole.  Other columns aren't read.  An empty table gives an empty table.
    """
    parts = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    ruled = parts.withColumn("found", matched_rule(rules, F.col("host"), F.col("path")))
    ruled = ruled.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("label"))
    ruled = cut(ruled)
    # equal texts get equal scores, so each distinct one is scored once
    scored = scored_texts(ruled)
    threshold, _ = calibrate(scored.where("label IS NOT NULL"))
    by_text = join_counted(ruled.withColumn("text", F.concat("host", "path")), scored.select("text", "n", "score"), ["text"], "n", ruled.count())
    verdict = F.coalesce("label", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return by_text.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
