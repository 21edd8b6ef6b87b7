"""String functions over code samples and model answers, as Column expressions.

White space is ASCII. A repeated group is possessive where it may run over a long line:
that is a loop in Java's engine, where other groups take a stack frame a repeat.
A null text counts as empty unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.arrays import let, places

#: File commands that make a sample depend on other files.
EXTERNAL_LITERALS = [
    r"\input{", r"\include{", r"\bibliography{", r"\addbibresource{", r"\subfile{",
    "plot file{", "plot file {", r"\pgfplotstableread{", r"\pgfplotstabletypeset{",
    r"\cite{", r"\citep{", r"\citet{", r"\printbibliography", "usepackage{xr}",
]
#: Log messages after which a compilation is tried again with shims.
RETRY_MESSAGES = [
    "Missing \\begin{document}",
    "I do not know the key '/tikz/op amp'",
    "Environment standalonepicture undefined",
    "I do not know the key '/pgfplots/mark options'",
    "I do not know the key '/tikz/grayblob'",
    "``latex",
    "```latex",
]
#: Replacements of an answer's normal form, in order.
SUBSTITUTIONS = [
    ("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"),
    (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}"),
]
#: Words and marks that an answer's normal form drops, in order.
REMOVED = [
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet",
    "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students", "childrentickets",
    "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}",
    "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
]
#: Patterns (with their replacement) that an answer's normal form unwraps, in order.
UNWRAPPED = [
    (r"(.*?)(\$)(.*?)(\$)(.*)", r"$$\3$$"), (r"(\\text\{)(.*?)(\})", r"\2"), (r"(\\textbf\{)(.*?)(\})", r"\2"),
    (r"(\\overline\{)(.*?)(\})", r"\2"), (r"(\\boxed\{)(.*)(\})", r"\2"), (r"(frac)([^{])(.)", r"frac{\2}{\3}"), (r"(sqrt)([^{])", r"sqrt{\2}"),
]

FENCE = r"(?is)```(?:latex)?\s*(.*?)\s*```"
LATEX_FENCE = r"(?is)```latex\s*(.*?)\s*```"
ONE_FENCE = r"(?is)\A```latex[ \t]*\n(.*?)\n```\z"
CODE_FENCE = r"(?is)```(?:latex|tex|tikz)?\s*\n(.*?)```"
BODY = r"(?is)\\begin\{document\}(.*)\\end\{document\}"
CLASS = r"(?is)\\documentclass(\[[^\]]*\])?\{([^}]*)\}"
BEGIN = r"(?i)\\begin\s*\{document\}"
END = r"(?i)\\end\s*\{document\}"
LINE_ENDS = "\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def literal(text: str) -> str:
    """A pattern that matches ``text`` itself, in Java and RE2."""
    return "".join(c if c.isalnum() or c in " _" else "\\" + c for c in text)


EXTERNAL = "(?i)" + "|".join([*map(literal, EXTERNAL_LITERALS), r"\\includegraphics\s*(?:\[[^\]]*\])?\s*\{[^}]+\}", r"\\addplot\s*(?:\[[^\]]*\])?\s*file\s*\{[^}]+\}"])


def empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def extract(text: Column, pattern: str, group: int, other: Column) -> Column:
    """A group of the first match, or ``other`` without a match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group)).otherwise(other)


def extract_latex(text: Column) -> Column:
    """The body of the first fence, else the whole text, trimmed."""
    text = strip(empty(text))
    return strip(extract(text, FENCE, 1, text))


def lines_unified(text: Column) -> Column:
    """All line ends as line feeds, without the last one."""
    return F.regexp_replace(F.regexp_replace(text, LINE_ENDS, "\n"), r"\n\z", "")


def strip_comments(text: Column, mode: str = "parity") -> Column:
    """Without comments: ``parity`` takes a sign behind an even run of backslashes, ``prev_char`` one not behind a backslash."""
    pattern = r"(?m)^((?:[^%\\\n]|\\[^\n])*+)%[^\n]*" if mode == "parity" else r"(?m)(^|[^\\\n])%[^\n]*"
    return F.regexp_replace(lines_unified(empty(text)), pattern, "$1")


def normalize_tex(text: Column) -> Column:
    """Comments out, blanks and empty lines squeezed, trimmed."""
    text = strip_comments(F.replace(empty(text), F.lit("\r\n"), F.lit("\n")), "prev_char")
    return strip(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def document_body(text: Column) -> Column:
    text = empty(text)
    return extract(text, BODY, 1, text)


def single_fence(text: Column) -> Column:
    """The code of a text that is one fence and nothing else; null otherwise or without code."""
    text = strip(empty(text))
    code = strip(F.regexp_extract(text, ONE_FENCE, 1))
    return F.when(text.rlike(ONE_FENCE) & (code != ""), code)


def is_complete(code: Column) -> Column:
    code = empty(code)
    return code.rlike(r"(?i)\\documentclass") & code.rlike(BEGIN) & code.rlike(END)


def best_effort(text: Column) -> Column:
    """Struct of ``code`` and ``status``: full_block, open_block, no_block or empty."""
    text = empty(text)
    full, start = r"(?is)```latex\s*(.*?)```", r"(?is)```latex(.*)"
    code = F.when(text.rlike(full), strip(F.regexp_extract(text, full, 1))).when(text.rlike(start), strip(F.regexp_extract(text, start, 1))).otherwise("")
    status = F.when(text == "", "empty").when(text.rlike(full), "full_block").when(text.rlike(start), "open_block").otherwise("no_block")
    return F.struct(code.alias("code"), status.alias("status"))


def problem(status: Column, code: Column) -> Column:
    return (
        F.when(status == "open_block", "LaTeX code block is not closed (``` missing). Output likely truncated.")
        .when(status == "no_block", "Missing ```latex ...``` block.")
        .when(strip(empty(code)) == "", "Empty LaTeX code.")
        .otherwise("")
    )


def is_standalone(code: Column) -> Column:
    return F.lower(F.regexp_extract(empty(code), CLASS, 2)).contains("standalone")


def replace_first(text: Column, pattern: str, by) -> Column:
    """``text`` with the first match replaced by ``by(match)``."""
    match = F.regexp_extract(text, pattern, 0)
    at = F.instr(text, match)
    changed = F.concat(F.substring(text, F.lit(1), at - 1), by(match), F.substring(text, at + F.length(match), F.length(text)))
    return F.when(text.rlike(pattern), changed).otherwise(text)


def inject_pagestyle(code: Column) -> Column:
    """An empty page style behind the beginning of the document, unless there is one."""
    insert = "\n\\pagestyle{empty}\\thispagestyle{empty}\n"
    added = replace_first(code, BEGIN, lambda m: F.concat(m, F.lit(insert)))
    return F.when(code.rlike(r"\\(this)?pagestyle\s*\{empty\}"), code).otherwise(added)


def six_digit_id(key: Column) -> Column:
    text = strip(F.coalesce(key.cast("string"), F.lit("0")))
    safe = F.substring(F.regexp_replace(text, r"[^\w\-.]+", "_"), 1, 128)
    number = F.regexp_replace(text, r"\A0+([0-9])", "$1")
    return F.when(text.rlike(r"\A[0-9]+\z"), F.lpad(number, F.greatest(F.length(number), F.lit(6)), F.lit("0"))).otherwise(safe)


def first_block(text: Column) -> Column:
    """The body of the first latex fence without line feeds at its ends; null without one."""
    return F.when(text.rlike(LATEX_FENCE), F.trim(F.regexp_extract(text, LATEX_FENCE, 1), F.lit("\n")))


def one_block(text: Column) -> Column:
    """The text as exactly one latex fence: leading fences off, cut at the next, stray marks out."""
    text = strip(F.regexp_replace(strip(empty(text)), r"\A(?:```latex\s*)+", ""))
    at = F.instr(text, "```")
    body = strip(F.when(at > 1, F.substring(text, F.lit(1), at - 1)).otherwise(text))
    body = strip(F.regexp_replace(body, r"(?i)```(?:latex)?\s*", ""))
    return F.concat(F.lit("```latex\n"), body, F.lit("\n```"))


def mime(path: Column) -> Column:
    path = F.lower(path)
    return F.when(path.endswith(".jpg") | path.endswith(".jpeg"), "image/jpeg").when(path.endswith(".webp"), "image/webp").otherwise("image/png")


def data_url(path: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), mime(path), F.lit(";base64,"), F.regexp_replace(F.base64(content), r"\r\n", ""))


def without_image_mark(question: Column) -> Column:
    return strip(F.replace(strip(empty(question)), F.lit("<image>"), F.lit("")))


def safe_name(text: Column) -> Column:
    return F.regexp_replace(empty(text), r"[^A-Za-z0-9_.\-]+", "_")


def code_of_response(text: Column) -> Column:
    """Code of a model's answer: first fence, stray marks off, line ends unified."""
    text = empty(text)
    text = strip(extract(text, CODE_FENCE, 1, text))
    text = F.regexp_replace(text, r"(?i)\A\s*`+\s*(?:latex|tex|tikz)?\s*", "")
    text = F.regexp_replace(text, r"\n\s*```\s*\z", "\n")
    return strip(F.translate(text, "\r\x00", "\n"))


def is_full_document(code: Column) -> Column:
    code = F.lower(empty(code))
    return code.contains("\\documentclass") | code.contains("\\begin{document}")


#: Fixed value: what keeps page numbers off.
NO_PAGE = "\\makeatletter\n\\let\\ps@plain\\ps@empty\n\\let\\ps@headings\\ps@empty\n\\let\\ps@firstpage\\ps@empty\n\\makeatother\n\\pagestyle{empty}\n\\begin{document}"


def no_page(code: Column) -> Column:
    begin = r"\\begin\s*\{document\}"
    changed = replace_first(code, begin, lambda m: F.lit(NO_PAGE))
    changed = F.replace(changed, F.lit("\\end{document}"), F.lit("\\thispagestyle{empty}\n\\end{document}"))
    return F.when(code.contains("{standalone}") | ~code.rlike(begin), code).otherwise(changed)


#: Packages that a wrapped fragment gets.
PREAMBLE = (
    "\n\\usepackage{tikz}\n\\usepackage{xcolor}\n\\usepackage{pgfplots}\n\\pgfplotsset{compat=1.18}\n"
    "\\usetikzlibrary{arrows.meta,calc,positioning,fit,backgrounds,intersections,\n                shapes.geometric,shapes.misc,patterns,\n"
    "                decorations.pathmorphing,decorations.pathreplacing,matrix}\n"
)


def wrapped(code: Column, shims: str = "") -> Column:
    """A fragment as a document of its own; ``shims`` go behind the preamble."""
    preamble = PREAMBLE + (f"\n{shims}" if shims else "")
    whole = F.concat(F.lit(f"\\documentclass[tikz]{{standalone}}\n{preamble}\n\\begin{{document}}\n"), code, F.lit("\n\\end{document}\n"))
    return F.when(is_full_document(code), code).otherwise(whole)


def needs_retry(log: Column) -> Column:
    out = F.lit(False)
    for message in RETRY_MESSAGES:
        out |= empty(log).contains(message)
    return out


def format_score(response: Column) -> Column:
    """Struct of ``score`` and ``violation``: 0.1 for one fence, -0.2 or -0.3 else."""
    response = empty(response)
    fences = F.regexp_count(response, F.lit(CODE_FENCE))
    open_ = response.contains("```") & ~response.rlike(r"(?m)```\s*$")
    score = F.when(fences == 1, 0.1).when((fences == 0) & open_, -0.3).otherwise(-0.2)
    violation = F.when(fences == 1, "").when(fences > 1, "multiple_fences").when(open_, "unclosed_fence").otherwise("no_fence")
    return F.struct(score.alias("score"), violation.alias("violation"))


def count_of(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def truncation_risk(code: Column, response: Column) -> Column:
    code, response = empty(code), empty(response)
    ended = F.lower(code).rlike(r"\\end\s*\{(?:document|tikzpicture)\}")
    uneven = F.abs(count_of(code, "{") - count_of(code, "}")) > 2
    return F.when((code == "") | (response == ""), 1.0).when(~response.rlike(r"(?m)```\s*$"), 0.8).when(~ended, 0.6).when(uneven, 0.4).otherwise(0.0)


def estimated_tokens(code: Column) -> Column:
    return F.floor(F.length(empty(code)) / 4).cast("int")


def compact(text: Column) -> Column:
    """A text in lower case without blanks and line feeds."""
    return F.replace(F.replace(F.lower(text), F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))


def char_grams(text: Column, n: int = 3) -> Column:
    """The set of character n-grams of a text in lower case without blanks and line feeds, as 64-bit hashes."""
    wide = F.encode(compact(text), "UTF-32")  # four bytes a character: a gram is a slice at a known place
    return let(wide, lambda t: F.array_distinct(F.transform(places(F.shiftright(F.octet_length(t), 2), n), lambda k: F.xxhash64(F.substring(t, 4 * k - 3, F.lit(4 * n))))))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets; 0 if one is empty."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(common / union)


def text_similarity(code: Column, reference: Column, share: Callable[[Column, Column], Column] | None = None) -> Column:
    """Jaccard of character trigrams, or what ``share`` gives for it (:func:`tessera.operators.metrics.trigram_share` for much text); without a reference 0.3 for code that draws, else 0."""
    code, reference = empty(code), empty(reference)
    draws = F.lower(code).contains("tikz") & (code.contains("\\draw") | code.contains("\\node"))
    return F.when(code == "", 0.0).when(reference == "", F.when(draws, 0.3).otherwise(0.0)).otherwise(share(code, reference) if share else jaccard(char_grams(code), char_grams(reference)))


def log_message(log: Column, errors: Column) -> Column:
    """The first three lines with an exclamation mark, else those about missing files, else the error output."""
    lines = F.transform(F.split(lines_unified(empty(log)), "\n"), strip)
    bang = F.filter(lines, lambda x: x.startswith("!"))
    missing = F.filter(lines, lambda x: F.lower(x).contains("not found"))
    first = F.when(F.size(bang) > 0, F.array_join(F.slice(bang, 1, 3), " | ")).when(F.size(missing) > 0, F.array_join(F.slice(missing, 1, 3), " | ")).otherwise("")
    fallback = F.when(strip(empty(errors)) == "", "Compile failed (unknown)").otherwise(strip(empty(errors)))
    return F.when(first == "", fallback).otherwise(first)


def error_lines(log: Column, last: int = 20, most: int = 3000) -> Column:
    """Lines that begin like errors, else the last ones; cut at ``most`` characters."""
    lines = F.split(lines_unified(empty(log)), "\n")
    marked = F.filter(lines, lambda x: strip(x).rlike(r"\A(?:!|l\.|L\.|\[TIMEOUT\])"))
    tail = F.slice(lines, F.greatest(F.size(lines) - last + 1, F.lit(1)), F.lit(last))
    text = F.array_join(F.when(F.size(marked) > 0, marked).otherwise(tail), "\n")
    return truncated(text, most, "\n...[log truncated]")


def truncated(text: Column, most: int, mark: str) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def filled(template: str, **columns: Column) -> Column:
    """``template`` with each ``{name}`` replaced by a column, in one pass: what stands in a column stays as it is."""
    from tessera.functions.templates import formatted

    return formatted(template, columns)


def repair_prompt(code: Column, error: Column, most: int = 10_000) -> Column:
    """The request for a minimal fix; long code is cut and the cut is noted."""
    code = empty(code)
    note = F.when(F.length(code) > most, "\n[Code truncated]\n").otherwise("")
    template = "Fix this LaTeX code with the fewest changes and answer with one fenced block.\n<ERROR_START>\n{error}\n<ERROR_END>\n<CODE_START>\n{code}\n<CODE_END>\n{note}\n"
    return filled(template, error=error, note=note, code=F.substring(code, 1, most))


def normalize_answer(answer: Column) -> Column:
    """The normal form of a final answer."""
    text = F.element_at(F.split(empty(answer), "="), -1)
    for before, after in SUBSTITUTIONS:
        text = F.replace(text, F.lit(before), F.lit(after))
    for word in REMOVED:
        text = F.replace(text, F.lit(word), F.lit(""))
    for pattern, by in UNWRAPPED:
        by = by.replace("$$", "\\$").replace(r"\3", "$3").replace(r"\2", "$2")
        fast = F.contains(text, F.lit("$")) if pattern.startswith("(.*?)") else None  # where there is none, each place would look for one to its line's end
        text = F.regexp_replace(text, pattern, by) if fast is None else F.when(fast, F.regexp_replace(text, pattern, by)).otherwise(text)
    text = F.replace(text, F.lit("$"), F.lit(""))
    plain = F.replace(text, F.lit(","), F.lit(""))
    return strip(F.when(plain.rlike(r"\A[0-9]+\z"), plain).otherwise(text))


def boxed(text: Column) -> Column:
    """What the last ``\\boxed{`` holds up to its own brace, trimmed; ``None`` without one that closes."""
    start = "\\boxed{"
    tail = F.substring_index(text, start, -1)
    pieces = F.regexp_extract_all(tail, F.lit(r"[^{}]*[{}]"), F.lit(0))
    begin = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("length"), F.lit(None).cast("int").alias("end"))

    def step(s: Column, piece: Column) -> Column:
        depth, length = s.depth + F.when(piece.endswith("{"), 1).otherwise(-1), s.length + F.length(piece)
        return F.struct(depth.alias("depth"), length.alias("length"), F.coalesce(s.end, F.when(depth == -1, length - 1)).alias("end"))

    end = F.aggregate(pieces, begin, step, lambda s: s.end)
    return F.coalesce(F.when(F.contains(text, F.lit(start)), strip(F.substring(tail, F.lit(1), end))), F.lit("None"))


def last_answer(response: Column) -> Column:
    """What follows the last ``Answer:``, else ``[INVALID]``."""
    found = F.regexp_extract_all(response, F.lit(r"(?i)Answer\s*:\s*([^\n]+)"), F.lit(1))
    return F.when(F.size(found) > 0, F.try_element_at(found, F.lit(-1))).otherwise("[INVALID]")


def boxed_format(response: Column) -> Column:
    return response.rlike(r"(?s)\A<think>.*</think>.*\\boxed\{.*\}.*\z").cast("double")


def answer_format(response: Column) -> Column:
    return response.rlike(r"(?s)\A<think>.*?</think>\s*<answer>.*?</answer>\z").cast("double")


def squeezed_marks(response: Column) -> Column:
    return F.regexp_replace(response, r"\s*([<>/])\s*", "$1")


def first_choice(response: Column) -> Column:
    return F.regexp_extract(empty(response), "[012]", 0)


def tokens(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(empty(text)), r"\s+"), lambda w: w != "")
