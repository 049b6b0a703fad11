"""Template answers, citations and validation over ranked candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: words that don't count as a query's terms
STOPWORDS = ["what", "is", "are", "the", "a", "an", "how", "why", "when", "where"]


def top(df: DataFrame, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))).where(F.col("rank") <= k)


def summary(df: DataFrame, least: int = 0, k: int = 3, size: int = 200, confidence: float = 0.7) -> DataFrame:
    """query_id, summary, confidence: the first characters of the best three contents."""
    del least
    parts = top(df, k).select("query_id", "rank", F.concat(F.substring("content", 1, size), F.lit("...")).alias("part"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "part"))), lambda s: s["part"]), " ")
    return parts.groupBy("query_id").agg(text.alias("summary")).withColumn("confidence", F.lit(confidence))


def citations(df: DataFrame, k: int = 10) -> DataFrame:
    return top(df, k).select("query_id", F.col("rank").alias("number"), "chunk_id", "doc_id", "vertical")


def day_month_year(text: Column) -> Column:
    """A date in one of three layouts as DD-MM-YYYY; null if it is none."""
    found = F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy")])
    return F.date_format(found, "dd-MM-yyyy")


def key_terms(query: Column) -> Column:
    return F.filter(F.split(F.lower(query), r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS))


def covered(query: Column, text: Column) -> Column:
    """Whether half of the query's terms occur in the text; true without terms."""
    terms, low = key_terms(query), F.lower(text)
    return (F.size(terms) == 0) | (F.size(F.filter(terms, lambda w: low.contains(w))) / F.greatest(F.size(terms), F.lit(1)) >= 0.5)


def claims(text: Column) -> Column:
    return F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (r"\d+%", r"\d{4}", r"(?i)Section\s+\d+", r"(?i)GO\.?\s*\w*\.?\s*No\.?\s*\d+")]))


def hallucinated(text: Column, source: Column) -> Column:
    """Whether more than 30 % of the claims are missing from the source."""
    found, low = claims(text), F.lower(source)
    missing = F.size(F.filter(found, lambda c: ~low.contains(F.lower(c))))
    return (F.size(found) > 0) & (missing / F.greatest(F.size(found), F.lit(1)) > 0.3)


def quality(issues: Column, government_first: Column, covers: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - 0.15 * issues + F.when(government_first, 0.1).otherwise(0.0) + F.when(covers, 0.1).otherwise(0.0)))


def cited_numbers(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))))


# fixed values: words of answers and queries that ask for verification
STATISTICS = ["enrollment", "dropout", "attendance", "achievement", "performance", "ratio", "rate", "percentage", "count", "total", "number of"]
RECENT = ["latest", "current", "recent", "now", "today", "2024", "2025", "as of", "up to date", "newest"]


def should_verify(answer: Column, query: Column, confidence: Column) -> Column:
    """Answers with numbers, with statistics where the query asks for recent ones, or of a confidence under 0.7."""
    return answer.rlike(r"\d") | F.lower(answer).rlike("|".join(STATISTICS)) & F.lower(query).rlike("|".join(RECENT)) | (confidence < 0.7)


def citation(vertical: Column, source: Column, section: Column, go_number: Column, case_number: Column, year: Column) -> Column:
    """A bibliography entry in the style of its vertical; parts that are null or empty are left out."""
    some = lambda prefix, c: F.when(c != "", F.concat(F.lit(prefix), c))
    name, when = F.coalesce(source, F.lit("Unknown Source")), F.concat(F.lit("("), year.cast("string"), F.lit(")"))
    parts = F.when(vertical == "legal", F.array(name, some("Section ", section), when)).when(vertical == "go", F.array(some("G.O. Ms. No. ", go_number), name, when))
    return F.concat_ws(", ", F.array_compact(parts.when(vertical == "judicial", F.array(some("", case_number), name, when)).otherwise(F.array(name, when))))


# fixed values: buckets of policy reasoning, the vertical and the most results of each; what issues call for
REASONING = {"constitutional_foundation": ("legal", 3), "statutory_framework": ("legal", 3), "administrative_orders": ("go", 3), "judicial_precedents": ("judicial", 2), "data_evidence": ("data", 2), "implementation_schemes": ("schemes", 2)}
SUGGESTIONS = [("citation", "Add proper citations to sources"), ("government", "Prioritize government/legal sources"), ("coverage", "Ensure answer addresses all query terms"), ("hallucination", "Verify all factual claims against sources")]


def reasoning(df: DataFrame) -> DataFrame:
    """query_id, bucket, place, chunk_id: the best results of each bucket's vertical."""
    place = F.row_number().over(Window.partitionBy("query_id", "vertical").orderBy(F.desc("score"), "chunk_id"))
    buckets = F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(v).alias("of"), F.lit(n).alias("most")) for b, (v, n) in REASONING.items()])
    rows = df.withColumn("place", place).where(F.col("place") <= max(n for _, n in REASONING.values()))
    mine = F.filter(buckets, lambda b: (b["of"] == F.col("vertical")) & (b["most"] >= F.col("place")))
    return rows.select("query_id", F.explode(mine).alias("b"), "place", "chunk_id").select("query_id", "b.bucket", "place", "chunk_id")


# fixed values: length of a bullet's text, first line of the answer, and its confidence
BULLET, NO_MODEL, NO_MODEL_CONFIDENCE = 220, "Model access failed; providing a direct summary from retrieved documents:", 0.2


def bullets(df: DataFrame, k: int) -> DataFrame:
    """query_id, answer, confidence: without a model, one numbered line for each of the best k results (query_id, chunk_id, doc_id, title, text, score).

    A result is named by its title, else its doc_id, else its number; empty ones count as missing, a null text as empty.
    """
    text = F.replace(F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\r\n\f")), F.lit("\n"), F.lit(" "))
    shown = F.when(F.length(text) > BULLET, F.concat(F.rtrim(F.left(text, F.lit(BULLET))), F.lit("..."))).otherwise(text)
    number = F.col("rank").cast("string")
    name = F.coalesce(F.nullif("title", F.lit("")), F.nullif(F.col("doc_id").cast("string"), F.lit("")), F.concat(F.lit("Document "), number))
    line = F.concat(F.lit("- ["), number, F.lit("] "), name, F.lit(": "), shown)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda s: s["line"])
    return top(df, k).groupBy("query_id").agg(F.concat_ws("\n", F.lit(NO_MODEL), lines).alias("answer"), F.lit(NO_MODEL_CONFIDENCE).alias("confidence"))


def citation_issues(cited: Column, known: Column) -> Column:
    """What is wrong with an answer's citations."""
    foreign = F.filter(cited, lambda c: c.isNotNull() & ~F.array_contains(known, c))
    named = F.transform(foreign, lambda c: F.concat(F.lit("Citation "), c.cast("string"), F.lit(" not in source results")))
    return F.when(F.size(cited) == 0, F.array(F.lit("No citations"))).otherwise(named)


def suggestions(issues: Column) -> Column:
    def one(issue: Column) -> Column:
        out = F.when(F.lit(False), "")
        for word, text in SUGGESTIONS:
            out = out.when(F.lower(issue).contains(word), text)
        return out

    return F.array_compact(F.transform(issues, one))


def parsed(text: Column) -> Column:
    """(summary, kind, body) of a model's answer: its direct answer and what follows, else its first paragraph in one line and the other lines."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    direct = r"(?is)1\.\s*\*\*Direct Answer:?\*\*\s*(.*?)(?=\n\d+\.|\n\n|\z)"
    whole = F.regexp_extract(t, direct, 0)
    rest = F.regexp_replace(F.substring(t, F.regexp_instr(t, F.lit(direct)) + F.length(whole), F.length(t)), r"^\s+|\s+$", "")
    lines = lambda x: F.filter(F.transform(F.split(x, "\n"), lambda y: F.trim(y)), lambda y: y != "")
    head = F.split(t, r"\n[ \t]*\n", 2)
    body = F.array_join(lines(F.coalesce(F.get(head, F.lit(1)), F.lit(""))), "\n")
    answered = F.struct(F.trim(F.regexp_extract(t, direct, 1)).alias("summary"), F.when(rest != "", "detailed_analysis").alias("kind"), rest.alias("body"))
    other = F.struct(F.array_join(lines(F.get(head, F.lit(0))), " ").alias("summary"), F.when(body != "", "main_content").alias("kind"), body.alias("body"))
    return F.when(whole != "", answered).otherwise(other)


def fenced_json(text: Column) -> Column:
    """From the first to the last brace of a fenced block, or of the text; the text itself without braces."""
    t = F.trim(text)
    inside = F.when(F.regexp_instr(t, F.lit(r"(?s)```(?:json)?\s*(.*?)\s*```")) > 0, F.trim(F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*?)\s*```", 1))).otherwise(t)
    first, last = F.instr(inside, "{"), F.length(inside) - F.instr(F.reverse(inside), "}") + 1
    return F.when((first > 0) & F.contains(inside, F.lit("}")), F.substring(inside, first, F.greatest(last - first + 1, F.lit(0)))).otherwise(inside)


def plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def locate(snippets: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page, confidence: the first page of its document where a snippet stands whole (exact), with its first 50 characters (medium) or with over 70 % of its longer words (low); page 1 and none elsewhere.

    snippets are (doc_id, snippet), pages (doc_id, page, text); a snippet meets its own document's pages alone.
    """
    s, t = plain(F.col("snippet")), plain(F.col("text"))
    head = F.substring(s, 1, 50)
    words = F.array_distinct(F.filter(F.split(s, " "), lambda w: F.length(w) > 3))
    shared = F.size(F.array_intersect(words, F.split(t, " "))) / F.greatest(F.size(words), F.lit(1))
    tier = F.when(t.contains(s), "exact").when((F.length(head) > 20) & t.contains(head), "medium").when((F.size(words) > 5) & (shared > 0.7), "low")
    best = snippets.join(pages, "doc_id", "left").withColumn("tier", tier).groupBy("doc_id", "snippet").agg(F.min(F.when(F.col("tier").isNotNull(), F.struct("page", "tier"))).alias("hit"))
    return best.select("doc_id", F.coalesce("hit.page", F.lit(1)).cast("int").alias("page"), F.coalesce("hit.tier", F.lit("none")).alias("confidence"))
