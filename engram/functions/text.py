"""Text as columns: HTML to text, chunks of markdown, sensitive spans, noise gates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_SKIP = {"title", "script", "style", "nav", "footer", "header", "noscript", "template"}
_BREAK = {"p", "div", "br", "li", "tr", "section", "article", "main", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote"}


class _Text(HTMLParser):
    """Gathers visible text; headings get their markdown marks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skipped = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self.skipped += 1
        elif tag in _BREAK:
            self.out.append("\n" + "#" * int(tag[1]) + " " if re.fullmatch("h[1-6]", tag) else "\n")

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skipped = max(0, self.skipped - 1)
        elif tag in _BREAK:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skipped:
            self.out.append(data)


def _visible(html: str | None) -> str:
    p = _Text()
    p.feed(html or "")
    p.close()
    lines = (" ".join(x.split()) for x in "".join(p.out).split("\n"))
    return "\n".join(x for x in lines if x and x.strip("# "))


@F.pandas_udf(StringType())
def html_to_text(html: pd.Series) -> pd.Series:
    """Visible text of pages, headings marked with #; scripts, styles and navigation are left out."""
    return html.map(_visible)


CHUNKS = "doc_id long, n int, heading string, level int, heading_path array<string>, content string, word_count int"


def _sections(text: str) -> Iterator[tuple[int, str, list[str]]]:
    level, heading, body, fence = 0, "", [], None
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        mark = re.match(r"\s{0,3}(```+|~~~+)", line)
        if mark:
            if fence is None:
                fence = mark[1]
            elif line.strip().startswith(fence) and not line.strip().strip(fence[0]):
                fence = None
        title = None if fence or mark else re.match(r"(#{1,6})\s+(.*?)\s*#*\s*$", line)
        if title:
            yield level, heading, body
            level, heading, body = len(title[1]), title[2], []
        else:
            body.append(line)
    yield level, heading, body


def _chunks(text: str, min_words: int, max_words: int) -> Iterator[tuple[str, int, list[str], str, int]]:
    stack: list[tuple[int, str]] = []
    for level, heading, body in _sections(text):
        if level:
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, heading))
        held: list[str] = []
        words = 0
        paragraphs = [p.strip() for p in re.split(r"\n\s*\n", "\n".join(body)) if p.strip()]
        paragraphs = [x for p in paragraphs for x in ([p] if len(p.split()) <= max_words else filter(str.strip, p.split("\n")))]
        for p in [*paragraphs, None]:
            n = len(p.split()) if p else 0
            if held and (p is None or words + n > max_words):
                if words >= min_words:
                    yield heading, level, [h for _, h in stack], "\n\n".join(held), words
                held, words = [], 0
            if p:
                held.append(p)
                words += n


def chunk_markdown(docs: DataFrame, *, min_words: int = 20, max_words: int = 500) -> DataFrame:
    """Sections of documents by heading, fences respected; long ones are cut between paragraphs, short ones left out."""

    def run(batches):
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                rows += [(doc, i, h, lv, path, body, n) for i, (h, lv, path, body, n) in enumerate(_chunks(text or "", min_words, max_words))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHUNKS.split(", ")])

    return docs.select("doc_id", "text").mapInPandas(run, CHUNKS)


def sibling_order(chunks: DataFrame) -> DataFrame:
    """BEFORE edges between chunks that follow each other under one heading path."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id", "heading_path").orderBy("n")
    return chunks.select("doc_id", F.col("n").alias("a"), F.lead("n").over(w).alias("b")).filter("b is not null").withColumn("weight", F.lit(0.25))


#: Kinds of sensitive text, their severity and pattern.
SENSITIVE = {
    "email": (2, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    "aws_key": (3, r"AKIA[0-9A-Z]{16}"),
    "private_key": (3, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    "ssn": (3, r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"),
    "ipv4": (1, r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"),
}


def sensitive_counts(docs: DataFrame, *, min_severity: int = 1) -> DataFrame:
    """doc_id, pattern, severity, matches of every kind that a document holds."""
    kinds = [(k, s, p) for k, (s, p) in SENSITIVE.items() if s >= min_severity]
    found = F.array(*[F.struct(F.lit(k).alias("pattern"), F.lit(s).alias("severity"), F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))).cast("long").alias("matches")) for k, s, p in kinds])
    return docs.filter("text is not null").select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.*").filter("matches > 0")


def redact(text: Column, *, min_severity: int = 2) -> Column:
    for kind, (severity, pattern) in SENSITIVE.items():
        if severity >= min_severity:
            text = F.regexp_replace(text, pattern, f"[{kind}]")
    return text


def noise_reason(text: Column, *, most: int = 50_000) -> Column:
    """Why a text should not be captured, or null: empty, too long, mostly symbols, or one word over and over."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\p{Nd}\s]", ""))
    return (
        F.when(text.isNull() | (F.trim(text) == ""), "empty")
        .when(F.length(text) > most, "too long")
        .when(letters < 0.5 * F.length(text), "symbols")
        .when((F.size(words) >= 20) & (F.size(F.array_distinct(words)) < 0.2 * F.size(words)), "repetition")
    )


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")


#: Words that show a cause, a time or a comparison, and marks of something specific or structured.
CAUSAL = r"(?i)\b(because|caused|due to|led to|resulted in|reason|since|therefore|so that|in order to|as a result|consequently)\b"
TEMPORAL = r"(?i)\b(after|before|then|when|while|during|until|once|first|next|previously|subsequently|earlier|later|following)\b"
COMPARATIVE = r"(?i)\b(over|instead of|replaced|vs|versus|compared to|rather than|better than|worse than|faster|slower|cheaper|preferred)\b"
SPECIFIC = (r"[\w/\\]+\.\w{1,5}\b(?<!\.\w\.)", r"\bv?\d+\.\d+(?:\.\d+)?\b", r"\b\d{3,}\b")
STRUCTURE = r"→|⟶|=>|->|-->"


def quality_points(text: Column, kind: Column, has_tags: Column, has_context: Column) -> Column:
    """0 to 10 for how much a memory is worth keeping: length, context, tags, type, reasoning, specifics and brevity."""
    size = F.length(F.regexp_replace(text, r"^\s+|\s+$", ""))
    one = lambda test: F.when(F.coalesce(test, F.lit(False)), 1).otherwise(0)
    specific = F.lit(False)
    for p in SPECIFIC:
        specific = specific | text.rlike(p)
    points = one(size >= 10) + one(size >= 50) + 3 * one(has_context) + one(has_tags) + one(kind.isNotNull() & (kind != "fact"))
    points = points + one(text.rlike(CAUSAL)) + one(text.rlike(TEMPORAL)) + one(text.rlike(COMPARATIVE)) + one(specific) + one(text.rlike(STRUCTURE)) + one(size.between(50, 300)) - 2 * one(size > 500)
    return F.greatest(F.lit(0), F.least(F.lit(10), points))


def quality_label(points: Column) -> Column:
    return F.when(points >= 7, "high").when(points >= 4, "medium").otherwise("low")
