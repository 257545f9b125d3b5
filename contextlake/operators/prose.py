"""Prose compression: rule packs over text with protected spans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextlake.functions.text import fold, hide_nul, js_trim, percent_saved, rough_tokens, show_nul

# The wordings that each pack drops or rewrites, in the order in which they apply.
POLITENESS = [
    (r"(?i)\bcould you (please )?", ""),
    (r"(?i)\bwould you (please )?(kindly )?", ""),
    (r"(?i)\bcan you (please )?(kindly )?", ""),
    (r"(?i)\bplease (could|would|can) you ", ""),
    (r"(?i)\bplease\b,?\s*", ""),
    (r"(?i)\bkindly\b,?\s*", ""),
    (r"(?i)\bif you don'?t mind\b,?\s*", ""),
    (r"(?i)\bif (it'?s )?possible\b,?\s*", ""),
    (r"(?i)\b(many )?thanks (in advance|so much|very much|a lot)\b\.?", ""),
    (r"(?i)\bthank you (in advance|so much|very much|kindly)\b\.?", ""),
    (r"(?im)\bthanks!?\s*$", ""),
    (r"(?im)\bthank you!?\s*$", ""),
    (r"(?i)\bi'?d (really )?appreciate (it )?if you (could|would|can) ", ""),
    (r"(?i)\bi was (just )?(wondering|hoping) (if|whether) (you (could|would|can) )?", ""),
    (r"(?i)\bi'?m (just )?(wondering|hoping) (if|whether) (you (could|would|can) )?", ""),
    (r"(?i)\bdo you (think you could|mind|think you can) ", ""),
]

HEDGING = [
    (r"(?i)\bi (think|believe|guess|suppose|reckon) (that )?", ""),
    (r"(?i)\bin my (opinion|view|experience)\b,?\s*", ""),
    (r"(?i)\bfrom my (perspective|point of view)\b,?\s*", ""),
    (r"(?i)\bit (seems|appears) (to me )?(that |like )?", ""),
    (r"(?i)\bif i'?m not mistaken\b,?\s*", ""),
    (r"(?i)\bcorrect me if i'?m wrong,?\s*(but )?", ""),
]

META = [
    (r"(?i)\bas (i )?(mentioned|said|stated|noted) (before|earlier|previously|above)\b,?\s*", ""),
    (r"(?i)\bas (previously|earlier) (mentioned|stated|noted)\b,?\s*", ""),
    (r"(?i)\bto be clear\b,?\s*", ""),
    (r"(?i)\bjust to (clarify|be clear|confirm)\b,?\s*", ""),
    (r"(?i)\bfor (your )?(clarity|reference|context)\b,?\s*", ""),
    (r"(?i)\bit (is|should be) (important to note|worth (noting|mentioning)) (that )?", ""),
    (r"(?i)\bit (is|should be) noted that\b,?\s*", ""),
    (r"(?i)\bplease (note|be aware|keep in mind) (that )?", ""),
    (r"(?i)\bfor what it'?s worth,?\s*", ""),
    (r"(?i)\bat the end of the day,?\s*", ""),
    (r"(?i)\bto make a long story short,?\s*", ""),
    (r"(?i)\blong story short,?\s*", ""),
]

PHRASES = [
    (r"(?i)\bin order to\b", "to"),
    (r"(?i)\bso as to\b", "to"),
    (r"(?i)\bfor the purpose of\b", "to"),
    (r"(?i)\bwith the intention of\b", "to"),
    (r"(?i)\bat (this|the present) (point in time|moment)\b", "now"),
    (r"(?i)\bat the present time\b", "now"),
    (r"(?i)\bdue to the fact that\b", "because"),
    (r"(?i)\bowing to the fact that\b", "because"),
    (r"(?i)\bin (the event|case) that\b", "if"),
    (r"(?i)\bin the case where\b", "if"),
    (r"(?i)\bon the off chance that\b", "if"),
    (r"(?i)\bthe reason (why )?is (that )?", "because "),
    (r"(?i)\bwith regards? to\b", "about"),
    (r"(?i)\bin reference to\b", "about"),
    (r"(?i)\bwith respect to\b", "about"),
    (r"(?i)\bin (the )?(case|context) of\b", "for"),
    (r"(?i)\ba (large|great) number of\b", "many"),
    (r"(?i)\ba (small|tiny) number of\b", "few"),
    (r"(?i)\bin spite of (the fact that )?", "despite "),
    (r"(?i)\bdespite the fact that\b", "although"),
    (r"(?i)\bregardless of (the fact that )?", "regardless "),
    (r"(?i)\bon the basis of\b", "from"),
    (r"(?i)\b(is|are|will be) able to\b", "can"),
    (r"(?i)\bhas the ability to\b", "can"),
    (r"(?i)\bhave the ability to\b", "can"),
    (r"(?i)\bin a (manner|way) that\b", "so"),
    (r"(?i)\bmake (a |the )?decision\b", "decide"),
    (r"(?i)\bgive consideration to\b", "consider"),
    (r"(?i)\btake into consideration\b", "consider"),
    (r"(?i)\bcome to (the )?conclusion (that )?", "conclude "),
    (r"(?i)\bin the process of\b", "while"),
    (r"(?i)\bprior to\b", "before"),
    (r"(?i)\bsubsequent to\b", "after"),
    (r"(?i)\bin the near future\b", "soon"),
    (r"(?i)\bat your earliest convenience\b", "soon"),
    (r"(?i)\bin the (very )?(near|distant) future\b", "soon"),
    (r"(?i)\ba majority of\b", "most"),
    (r"(?i)\bthe majority of\b", "most"),
    (r"(?i)\ba sufficient (amount|number) of\b", "enough"),
    (r"(?i)\bin close proximity to\b", "near"),
    (r"(?i)\bin order for\b", "for"),
    (r"(?i)\bwhether or not\b", "whether"),
    (r"(?i)\beach and every\b", "each"),
    (r"(?i)\bany and all\b", "all"),
    (r"(?i)\bfew and far between\b", "rare"),
    (r"(?i)\bfirst and foremost\b", "first"),
    (r"(?i)\bnull and void\b", "void"),
    (r"(?i)\bend result\b", "result"),
    (r"(?i)\bfinal outcome\b", "outcome"),
    (r"(?i)\bpast history\b", "history"),
    (r"(?i)\bfuture plans\b", "plans"),
    (r"(?i)\bactual fact\b", "fact"),
    (r"(?i)\btrue fact\b", "fact"),
    (r"(?i)\bcompletely (eliminate|destroy|finish)\b", "$1"),
    (r"(?i)\btotally (eliminate|destroy|finish)\b", "$1"),
]

FILLER = [
    (r"(?i)\bactually\b,?\s*", ""),
    (r"(?i)\bbasically\b,?\s*", ""),
    (r"(?i)\bliterally\b,?\s*", ""),
    (r"(?i)\bessentially\b,?\s*", ""),
    (r"(?i)\bpretty much\b,?\s*", ""),
    (r"(?i)\bsort of\b,?\s*", ""),
    (r"(?i)\bkind of\b,?\s*", ""),
    (r"(?i)\bin a way\b,?\s*", ""),
    (r"(?i)\bvery (much )?", ""),
    (r"(?i)\breally\b,?\s*", ""),
    (r"(?i)\bquite\b,?\s*", ""),
    (r"(?i)\brather\b,?\s*", ""),
    (r"(?i)\bsomewhat\b,?\s*", ""),
    (r"(?i)\bsimply\b,?\s*", ""),
    (r"(?i)\bjust\b,?\s*", ""),
]

# "environment variables" no longer occurs where its rule stands: "environment" is rewritten before it.
ABBREVIATIONS = [
    (rf"(?i)\b{long}\b", short)
    for long, short in [
        ("authentication", "auth"),
        ("authorization", "authz"),
        ("application", "app"),
        ("applications", "apps"),
        ("configuration", "config"),
        ("configurations", "configs"),
        ("documentation", "docs"),
        ("database", "db"),
        ("databases", "dbs"),
        ("environment", "env"),
        ("environments", "envs"),
        ("environment variables?", "env vars"),
        ("parameters?", "params"),
        ("repository", "repo"),
        ("repositories", "repos"),
        ("director(y|ies)", "dir"),
        ("information", "info"),
        ("development", "dev"),
        ("production", "prod"),
        ("dependenc(y|ies)", "dep"),
        ("performance", "perf"),
        ("initialization", "init"),
        ("initialize", "init"),
        ("synchronization", "sync"),
        ("asynchronous", "async"),
        ("synchronous", "sync"),
    ]
]

PUNCTUATION = [(r"!{2,}", "!"), (r"\?{2,}", "?"), (r"\.{4,}", "..."), (r",{2,}", ","), (r"\s+([.,;:!?])", "$1")]
WHITESPACE = [(r"[ \t]+", " "), (r"\n{3,}", "\n\n"), (r"(?m)[ \t]+$", "")]

PACKS = {"politeness": POLITENESS, "hedging": HEDGING, "meta": META, "phrases": PHRASES, "filler": FILLER, "abbreviations": ABBREVIATIONS}


@dataclass(frozen=True)
class Preset:
    packs: tuple[str, ...] = ()
    punctuation: bool = True
    whitespace: bool = True
    protect_code: bool = True


PRESETS = {
    "light": Preset(),
    "default": Preset(("politeness", "hedging", "meta", "phrases")),
    "aggressive": Preset(tuple(PACKS)),
}

KEEP = r"(?is)<keep>(.*?)</keep>"
FENCE = r"(?s)```.*?```"
INLINE = r"`[^`\n]+`"


def mark_of(kind: str) -> str:
    return f"\x00{kind}\x00"


def stash(text: Column, pattern: str, kind: str, group: int) -> tuple[Column, Column]:
    """(text with one mark per span, array of the spans)."""
    return F.regexp_replace(text, pattern, mark_of(kind)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def restore(text: Column, spans: Column, kind: str) -> Column:
    """Put the spans back in order; rules neither drop nor repeat a mark."""
    pieces = F.split(text, mark_of(kind), -1)
    return F.array_join(F.zip_with(pieces, spans, lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")


def compress(df: DataFrame, text_col: str = "text", preset: str | Preset = "default", tokens=rough_tokens) -> DataFrame:
    """``df`` with ``output``, ``rules_applied`` and token counts; null text stays null,
    and U+0000 is an ordinary character."""
    p = PRESETS[preset] if isinstance(preset, str) else preset
    d, kinds = df.withColumn("_t", hide_nul(F.col(text_col))), []
    for kind, pattern, group in (("K", KEEP, 1), ("C", FENCE, 0), ("I", INLINE, 0)):
        if kind == "K" or p.protect_code:
            marked, spans = stash(F.col("_t"), pattern, kind, group)
            d = d.withColumn(f"_{kind}", spans).withColumn("_t", marked)
            kinds.append(kind)
    labels = [F.when(F.size("_K") > 0, F.lit("preserve-keep-regions"))]
    steps = [(name, lambda c, n=name: fold(c, PACKS[n])) for name in p.packs]
    steps += [("punctuation", lambda c: fold(c, PUNCTUATION))] if p.punctuation else []
    steps += [("whitespace", lambda c: js_trim(fold(c, WHITESPACE)))] if p.whitespace else []
    for i, (name, step) in enumerate(steps):
        d = d.withColumn(f"_b{i}", F.col("_t")).withColumn("_t", step(F.col("_t")))
        d = d.withColumn(f"_a{i}", F.col("_t"))
        labels.append(F.when(F.col(f"_b{i}") != F.col(f"_a{i}"), F.lit(name)))
    for kind in reversed(kinds):
        d = d.withColumn("_t", restore(F.col("_t"), F.col(f"_{kind}"), kind))
    d = d.withColumn("_t", show_nul(F.col("_t")))
    before, after = tokens(F.col(text_col)), tokens(F.col("_t"))
    d = d.withColumn("output", F.col("_t")).withColumn("rules_applied", F.array_compact(F.array(*labels)))
    d = d.withColumn("original_tokens", before).withColumn("output_tokens", after).withColumn("percent_saved", percent_saved(before, after))
    return d.drop("_t", *[f"_{k}" for k in "KCI"], *[f"_{x}{i}" for x in "ab" for i in range(len(steps))])

