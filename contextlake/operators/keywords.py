"""Keywords of a text, and files ranked by them under a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contextlake.functions.text import skip_greedy

# Words that never tell files or symbols apart.
STOPWORDS = tuple(
    """
a an the and or but if then else so as than because while with without from to into for of in on at by about against
between through during before after above below up down out off over under again further once here there now just only
same also too very really quite rather such some any few many much most other all each every
i me my mine we us our you your he him his she her it its they them their this that these those
is are was were be been being am do does did have has had will would could should may might must can cannot shall ought
what which who whom when where why how
fix add remove update check show make get set let use see try help please thanks thank explain review tell find look take
want need build run
code file files function functions method methods class classes bug bugs issue issues problem problems error errors
thing things something someone anything everything stuff way ways line lines part parts test tests module modules
project app application source feature features
maybe perhaps possibly probably definitely certainly always never often sometimes usually generally typically
good bad better worse best worst new old simple easy hard one two three four five six seven eight nine ten
""".split()
)

# Lengths of the grams by which names are found; a keyword goes by the longest that it holds.
GRAMS = (3, 5, 8, 12, 20, 32, 52)
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_$]*"


def score(token: Column) -> Column:
    """1, and more for inner capitals (2), underscores (2) and a first capital
    (1); a short plain word loses one, but not its last."""
    inner = token.rlike("^.+[A-Z]")
    under = token.contains("_")
    raw = F.lit(1) + F.when(inner, 2).otherwise(0) + F.when(under, 2).otherwise(0) + F.when(token.rlike("^[A-Z]"), 1).otherwise(0)
    plain = ~inner & ~under & (F.length(token) <= 4)
    return F.when(plain, F.greatest(raw - 1, F.lit(1))).otherwise(raw).cast("long")


def extract(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keyword, score, first_pos, rank): rank 1 is the best."""
    text = F.regexp_replace(F.regexp_replace(F.col(text_col), r"```[\s\S]*?```", " "), r"`[^`]*`", " ")
    tokens = df.select(id_col, F.posexplode(F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0))).alias("pos", "token"))
    tokens = tokens.filter(F.length("token") >= 3).withColumn("keyword", F.lower("token")).filter(~F.col("keyword").isin(*STOPWORDS))
    sums = tokens.groupBy(id_col, "keyword").agg(F.sum(score(F.col("token"))).alias("score"), F.min("pos").cast("long").alias("first_pos"))
    best = Window.partitionBy(id_col).orderBy(F.col("score").desc(), "first_pos")
    return sums.withColumn("rank", F.row_number().over(best).cast("long"))


def file_hits(keywords: DataFrame, files: DataFrame, symbols: DataFrame, most: int = 30) -> DataFrame:
    """(doc_id, rel_path, score): 3 per matching symbol of the first 8 keywords,
    5 per file name with one of the first 6, each up to ``most`` per keyword.

    What a keyword hits depends on the keyword alone, so distinct keywords are
    looked up and documents are joined to the hits that stay.  A keyword (of three
    characters or more, as ``extract`` gives them) goes by the rarest of its
    longest grams: these cover most of it, so few names share one and do not hold
    it, and candidates grow with the hits.  Of rows with equal names only the first
    ``most`` can stay.  All tables here grow with the corpus: they are merged and
    never broadcast.
    """

    def grams(c: str, sizes: str) -> Column:
        every = f"transform(sequence(1, length({c}) - q + 1), i -> xxhash64(substring({c}, i, q)))"
        return F.explode(F.expr(f"array_distinct(flatten(transform({sizes}, q -> {every})))")).alias("gram")

    def top(words: DataFrame, names: DataFrame, order: list[str]) -> DataFrame:
        """(keyword, rel_path) of the first ``most`` rows of ``names`` by ``order`` whose ``n`` holds the keyword."""
        held = f"filter(array({', '.join(map(str, GRAMS))}), q -> q <= length({{0}}))"
        distinct = names.select("n").distinct().select("n", grams("n", held.format("n")))
        df = distinct.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
        wanted = words.select("keyword").distinct().select("keyword", grams("keyword", f"slice({held.format('keyword')}, -1, 1)"))
        rarest = wanted.join(df.hint("merge"), "gram").groupBy("keyword").agg(F.min(F.struct("df", "gram")).alias("m"))
        pairs = rarest.select("keyword", F.col("m.gram").alias("gram")).join(distinct.hint("merge"), "gram").filter(F.expr("contains(n, keyword)")).select("keyword", "n")
        first = names.withColumn("r", F.row_number().over(Window.partitionBy("n").orderBy(*order))).filter(F.col("r") <= most).drop("r")
        per = Window.partitionBy("keyword").orderBy(*order)
        return pairs.join(first.hint("merge"), "n").withColumn("r", F.row_number().over(per)).filter(F.col("r") <= most).select("keyword", "rel_path")

    kw = keywords.filter("rank <= 8").select("doc_id", "keyword", "rank")
    sym = symbols.select("rel_path", F.lower("name").alias("n"), "symbol_no")
    by_symbol = kw.join(top(kw, sym, ["symbol_no", "rel_path"]).hint("merge"), "keyword")
    named = files.select("rel_path", F.lower(F.regexp_extract("rel_path", r"[^/]*$", 0)).alias("n"))
    first = kw.filter("rank <= 6")
    by_name = first.join(top(first, named, ["rel_path"]).hint("merge"), "keyword")
    hits = by_symbol.select("doc_id", "rel_path", F.lit(3).alias("s")).unionByName(by_name.select("doc_id", "rel_path", F.lit(5).alias("s")))
    return hits.groupBy("doc_id", "rel_path").agg(F.sum("s").cast("long").alias("score"))


def select_files(hits: DataFrame, sizes: DataFrame, max_files: int = 5, budget: int = 4000, per_file: int = 4000) -> DataFrame:
    """The best files of each document that fit the budget: candidates by score,
    re-ranked with a penalty for size, then taken greedily with skipping."""
    bound = max(2 * max_files, 10)
    by_score = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "rel_path")
    best = hits.withColumn("r", F.row_number().over(by_score)).filter(F.col("r") <= bound).join(sizes.hint("merge"), "rel_path")
    fit = best.filter((F.col("tokens") > 0) & (F.col("tokens") <= per_file))
    fit = fit.withColumn("adjusted", F.round(F.col("score") - F.log10(1 + F.col("tokens") / 100), 9))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("adjusted")).alias("o"), "rel_path", "tokens", "score")))
    chosen = skip_greedy(ordered, lambda x: x["tokens"], F.lit(budget), F.lit(max_files))
    picked = fit.groupBy("doc_id").agg(chosen.alias("p")).select("doc_id", F.posexplode("p").alias("i", "p"))
    return picked.select("doc_id", (F.col("i") + 1).cast("long").alias("rank"), F.col("p.rel_path").alias("rel_path"), F.col("p.tokens").alias("tokens"), F.col("p.score").alias("score"))
