"""Problem 5: markup residue in texts.

Minimum-cut labelling. The lines of a text are the nodes of a graph, one graph
for each kind of markup. A classifier (``markup_lines``: a logistic regression on
what a line shows, fitted on labelled lines made by a rule) gives each line its
probability of being in that markup; minus the logarithms of it and of its
complement are the terminal capacities. Neighbouring lines, and lines that open
alike at the same depth of an element or list, are joined by smoothness edges.
Max-flow then separates lines in that markup from plain ones: lines that might
be either go with the lines around them, so a single look-alike among plain
lines is plain, and one inside a block of markup belongs to it. The kinds found
are those with a line on their side of the cut. In lines of HTML a second cut
separates content from boilerplate (scripts, menus, link lists).

Lines so labelled are converted: headings become ``#`` lines, items ``-`` lines
indented by their depth, code blocks fenced, table rows cells between bars (rows
whose cells stand on several lines are joined first), formulas stay between
dollar signs, those of several lines between double ones. The content of code
blocks is never looked at and comes out as it was.

Defined results: null texts give a null text, no markup and no fixes; empty and
plain texts come out as they are; unclosed and crossed tags are tolerated;
repeated rows give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselar.llm.markup_lines import COMMENT, ENTITY, FORMULA, INSIDE, KINDS, MARKS, SETEXT, TAG, TAGS, Costs, features, fitted_costs
from tesselar.llm.mincut import min_cut_labels

CODE = re.compile(
    r"(?P<fence>^[ \t]*(?:```|~~~)[^\n]*\n.*?(?:^[ \t]*(?:```|~~~)[ \t]*$|\Z))"
    r"|(?P<pre><pre\b[^>]*>.*?(?:</pre\s*>|\Z))|(?P<escaped>&lt;pre\b.*?&gt;.*?(?:&lt;/pre\s*&gt;|\Z))"
    r"|(?P<math>\\begin\{(?P<environment>equation|align|gather|multline|eqnarray|displaymath)(?P<star>\*?)\}.*?\\end\{(?P=environment)(?P=star)\}|\\\[[^\n]*\n.*?\\\]|\$\$[^$\n]*\n[^$]*\$\$)"
    r"|(?P<verbatim>\\begin\{(?:verbatim|lstlisting|minted)\}.*?(?:\\end\{(?:verbatim|lstlisting|minted)\}|\Z))"
    r"|(?P<inline>(?<!`)`[^`\n]+`(?!`))",
    re.S | re.M | re.I,
)
LINK = re.compile(r"\[[^\[\]\n]+\]\([^()\s]+\)")
COMMAND = re.compile(r"\\[A-Za-z]+\*?\{[^{}\n]*\}")
HIDE, SHOW = "\ue000", "\ue001"
HIDDEN = re.compile(HIDE + r"(\d+)" + SHOW)
ROW = re.compile(r"<tr\b(?:(?!</tr|<tr\b).)*</tr\s*>", re.S | re.I)
PLACE = re.compile(r"\s*(?:<\w+|[-*#|+>&]|\\\w+|\d+[.)])?")


class Blocks:
    """A text as lines, the content of its code blocks set aside."""

    def __init__(self, text: str):
        self.code: list[tuple[str, str]] = []

        def hide(m: re.Match) -> str:
            kind = next(k for k in INSIDE if m.group(k) is not None)
            self.code.append((kind, m.group(0)))
            return f"{HIDE}{len(self.code) - 1}{SHOW}"

        text = text.replace(HIDE, "").replace(SHOW, "")
        self.lines: list[str] = []
        text = CODE.sub(hide, text)
        if "<tr" in text or "<TR" in text:  # a table's row is one line
            text = ROW.sub(lambda m: re.sub(r"\s*\n\s*", " ", m.group(0)), text)
        for line in text.split("\n"):
            if self.lines and line.strip() and self._goes_on(self.lines[-1], line):
                self.lines[-1] += " " + line.lstrip()
            else:
                self.lines.append(line)

    @staticmethod
    def _goes_on(line: str, following: str) -> bool:
        """Whether a construct that ``line`` opens is closed in the next line: a hard wrap cut it."""
        for opening, closing in (("[[", "]]"), ("{{", "}}"), ("<!--", "-->")):
            if line.rfind(opening) > line.rfind(closing) and closing in following and opening != closing:
                return True
        at = line.rfind("<")
        if at >= 0 and ">" not in line[at:] and TAG.match(line[at:] + " " + following.lstrip()):
            return True
        for mark in ("**", "~~", "'''"):
            if line.count(mark) % 2 and following.count(mark) % 2:
                return True
        at = max(line.rfind("["), line.rfind("\\"), line.rfind("$"))
        if at >= 0:
            tail, whole = line[at:], line[at:] + " " + following.lstrip()
            for pattern in (LINK, COMMAND, FORMULA):
                if (m := pattern.match(whole)) and m.end() > len(tail) and not pattern.match(tail):
                    return True
        return False

    def inside(self, line: str) -> str:
        if HIDE not in line:
            return ""
        kinds = {self.code[int(n)][0] for n in HIDDEN.findall(line)}
        return next((k for k in INSIDE if k in kinds), "")


def label_lines(lines: list[str], shown: list[dict[int, float]], costs: Costs) -> dict[str, list[bool]]:
    """{kind: which lines are in that markup}, kinds without a line left out; ``shown``: the lines' features."""
    full = [i for i, line in enumerate(lines) if line.strip()]
    edges = None
    out = {}
    for kind, margins in zip(KINDS, costs.margins(shown)):
        if all(margins[i] <= 0 for i in full):
            continue  # every line is cheaper off, and edges cost nothing then: this is the least cut
        if edges is None:
            edges, last = [(a, b, costs.smooth) for a, b in zip(full, full[1:])], {}
            for i in full:  # lines that open alike at one depth: items of a list, rows of a table, siblings
                place = PLACE.match(lines[i]).group(0)
                if place.strip():
                    if place in last and last[place] != i - 1:
                        edges.append((last[place], i, costs.smooth / 2))
                    last[place] = i
        at = [min(max(m, -30.0), 30.0) for m in margins]
        off = [math.log1p(math.exp(m)) if lines[i].strip() else 0.0 for i, m in enumerate(at)]
        on = [math.log1p(math.exp(-m)) if lines[i].strip() else 1.0 for i, m in enumerate(at)]
        labels = min_cut_labels(off, on, edges)
        if any(labels):
            out[kind] = labels
    return out


def labels_of(blocks: Blocks, costs: Costs | None = None) -> dict[str, list[bool]]:
    lines = blocks.lines
    if not any(MARKS.search(line) or HIDE in line for line in lines):
        return {}
    shown = [features(line, lines[i - 1] if i else "", blocks.inside(line)) if line.strip() else {} for i, line in enumerate(lines)]
    return label_lines(lines, shown, costs or fitted_costs())


def boilerplate(lines: list[str], marked: list[bool]) -> list[bool]:
    """Which lines are boilerplate, by a cut over text length, link density and the elements around."""
    off, on, depths, depth, hidden = [], [], [], 0, ""
    for line, own in zip(lines, marked):
        low = line.lower()
        start = re.search(r"<(script|style|nav|footer|aside|noscript|form|header)\b", low) if own else None
        in_hidden = bool(hidden or start)
        if start and f"</{start.group(1)}" not in low:
            hidden = start.group(1)
        elif hidden and f"</{hidden}" in low:
            hidden = ""
        bare = COMMENT.sub("", re.sub(r"<(script|style)\b.*?</\1\s*>", "", line, flags=re.I | re.S)) if own else line
        plain = TAG.sub(" ", bare)
        words = len(plain.split())
        linked = sum(len(x.split()) for x in re.findall(r"<a\b[^>]*>(.*?)</a>", bare, re.I | re.S)) if own else 0
        density = linked / words if words else 0.0
        only_hidden = own and not words and line.strip() != "" and not TAG.fullmatch(line.strip())
        off.append((4.0 if in_hidden and not (start and words) else 0.0) + (4.0 if only_hidden and HIDE not in line else 0.0) + 2.0 * density)
        on.append(0.4 + 0.15 * words * (1 - density) + (4.0 if HIDE in line else 0.0))
        depth += len(re.findall(r"<(?:div|ul|ol|table|section|nav|article)\b", low)) - len(re.findall(r"</(?:div|ul|ol|table|section|nav|article)\b", low))
        depths.append(depth)
    full = [i for i, line in enumerate(lines) if line.strip()]
    edges = [(a, b, 0.2 + 0.2 * (depths[a] == depths[b])) for a, b in zip(full, full[1:])]
    return min_cut_labels(off, on, edges)


class Fixes(dict):
    depth = 0  # of the list that the conversion is in

    def sub(self, name: str, pattern: str | re.Pattern, to, text: str, flags: int = 0) -> str:
        text, n = re.subn(pattern, to, text, flags=flags) if isinstance(pattern, str) else pattern.subn(to, text)
        if n:
            self[name] = self.get(name, 0) + n
        return text


def from_html(line: str, fixes: Fixes) -> str:
    if "&lt;" in line and re.search(rf"&lt;/?(?:{TAGS}|!--)", line, re.I):
        line = fixes.sub("html_tags_unescaped", r"&lt;(/?\w[^&]*(?:&(?!gt;)[^&]*)*|!--.*?--)&gt;", r"<\1>", line)
    line = fixes.sub("html_comments_removed", COMMENT, "", line)
    line = re.sub(r"<(script|style)\b.*?</\1\s*>", "", line, flags=re.I | re.S)
    line = re.sub(r"<h([1-6])\b[^>]*>", lambda m: "\n" + "#" * int(m.group(1)) + " ", line, flags=re.I)

    def listed(m: re.Match) -> str:
        if m.group(2).lower() == "li":
            return "" if m.group(1) else "\n" + "  " * max(0, fixes.depth - 1) + "- "
        fixes.depth = max(0, fixes.depth + (-1 if m.group(1) else 1))
        return m.group(0)

    line = re.sub(r"<(/?)(ul|ol|li)\b[^>]*>", listed, line, flags=re.I)
    line = re.sub(r"<tr\b[^>]*>\s*", "\n| ", line, flags=re.I)
    line = re.sub(r"</t[dh]\s*>\s*(?=<t[dh])", " | ", line, flags=re.I)
    line = re.sub(r"</t[dh]\s*>", " |", line, flags=re.I)
    line = re.sub(r"<sup\b[^>]*>(.*?)</sup\s*>", r"^\1", line, flags=re.I)
    line = re.sub(r"<sub\b[^>]*>(.*?)</sub\s*>", r"_\1", line, flags=re.I)
    line = re.sub(r"<(?:br|hr)\b[^>]*>|</(?:p|div|h[1-6]|ul|ol|table|blockquote)\s*>", "\n", line, flags=re.I)
    line = fixes.sub("html_tags_removed", TAG, "", line)

    def decoded(m: re.Match) -> str:
        return html.unescape(m.group(0)).replace("\xa0", " ")

    return fixes.sub("html_entities_decoded", ENTITY, decoded, line)


def from_markdown(line: str, fixes: Fixes) -> str:
    line = fixes.sub("markdown_images_removed", r"!\[([^\]\n]*)\]\([^)\n]*\)", r"\1", line)
    line = fixes.sub("markdown_links_removed", r"\[([^\[\]\n]+)\]\([^()\s]+(?:\s+\"[^\"]*\")?\)", r"\1", line)
    line = fixes.sub("markdown_emphasis_removed", r"\*\*(?=\S)([^*\n]+?)\*\*|~~(?=\S)([^~\n]+?)~~", lambda m: m.group(1) or m.group(2), line)
    line = fixes.sub("markdown_quotes_removed", r"^\s{0,3}(?:>\s?)+", "", line)
    line = fixes.sub("markdown_tasks_removed", r"^(\s*[-*+]\s+)\[[ xX]\]\s", r"\1", line)
    line = fixes.sub("markdown_rules_removed", r"^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*$", "", line)
    return re.sub(r"^(\s*)[*+](?=\s)", r"\1-", line)


def from_wiki(line: str, fixes: Fixes) -> str:
    line = fixes.sub("wiki_headings_converted", r"^\s*(={2,6})\s*([^=].*?)\s*\1\s*$", lambda m: "#" * len(m.group(1)) + " " + m.group(2), line)
    line = fixes.sub("wiki_formulas_converted", r"\{\{math\|(.*?)\}\}(?!\})", lambda m: "$" + m.group(1).replace("{{=}}", "=") + "$", line)
    line = fixes.sub("wiki_templates_removed", r"\{\{[^{}\n]*\}\}", "", line)
    line = fixes.sub("wiki_files_removed", r"\[\[(?:File|Image|Category):[^\[\]\n]*\]\]", "", line)
    line = fixes.sub("wiki_links_removed", r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]+)\]\]", r"\1", line)
    line = fixes.sub("wiki_emphasis_removed", r"'''?(?=[^\s'])([^'\n]+?)'''?", r"\1", line)
    line = fixes.sub("wiki_tables_converted", r"^\s*(?:\{\|.*|\|\}|\|-+)\s*$", "", line)
    if "||" in line:
        line = "| " + " | ".join(c.strip() for c in re.sub(r"^\s*[|!]", "", line).split("||")) + " |"
    return re.sub(r"^\s*(\*+)\s*(?=\S)", lambda m: "  " * (len(m.group(1)) - 1) + "- ", line)


def from_latex(line: str, fixes: Fixes) -> str:
    formulas: list[str] = []

    def keep(m: re.Match) -> str:
        formulas.append(m.group(0))
        return f"\ue002{len(formulas) - 1}\ue003"

    line = re.sub(r"\\\[\s*(.*?)\s*\\\]|\\\(\s*(.*?)\s*\\\)", lambda m: f"${m.group(1) or m.group(2)}$", line)
    line = FORMULA.sub(keep, line)
    line = fixes.sub("latex_headings_converted", r"\\(chapter|section|subsection|subsubsection|paragraph)\*?\{([^{}]*)\}", lambda m: "#" * (1 + m.group(1).count("sub")) + " " + m.group(2), line)
    nested = len(re.findall(r"\\begin\{(?:itemize|enumerate|description)\}", line)) - len(re.findall(r"\\end\{(?:itemize|enumerate|description)\}", line))
    fixes.depth = max(0, fixes.depth + nested)
    line = fixes.sub("latex_items_converted", r"^\s*\\item(?:\[[^\]]*\])?\s*", "  " * max(0, fixes.depth - 1) + "- ", line)
    line = fixes.sub("latex_environments_removed", r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?(?:\{[^{}]*\})*", "", line)
    line = fixes.sub("latex_references_removed", r"~?\\(?:cite[a-z]*|label|ref|eqref|pageref)\{[^{}]*\}", "", line)
    line = fixes.sub("latex_footnotes_converted", r"\\footnote\{([^{}]*)\}", r"(\1)", line)
    for _ in range(3):
        line = fixes.sub("latex_commands_removed", r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}", r"\1", line)
    if re.search(r"(?<!\\)&", line):
        line = "| " + " | ".join(c.strip() for c in re.split(r"(?<!\\)&", re.sub(r"\\\\\s*$", "", line))) + " |"
    line = re.sub(r"\\\\\s*$|\\(?:noindent|maketitle|hline|centering|par)\b", "", line).replace("~", " ")
    line = re.sub(r"\\([&%$#_{}])", r"\1", line)
    return re.sub("\ue002(\\d+)\ue003", lambda m: formulas[int(m.group(1))], line)


CONVERT = {"html": from_html, "markdown": from_markdown, "wiki": from_wiki, "latex": from_latex}


def _code(kind: str, raw: str, fixes: Fixes) -> str:
    if kind == "inline":
        fixes["markdown_code_marks_removed"] = fixes.get("markdown_code_marks_removed", 0) + 1
        return raw[1:-1]
    fixes["code_blocks_kept"] = fixes.get("code_blocks_kept", 0) + 1
    if kind == "fence":
        return raw
    if kind == "math":
        body = re.sub(r"\A(?:\\begin\{\w+\*?\}|\\\[|\$\$)\s*|\s*(?:\\end\{\w+\*?\}|\\\]|\$\$)\Z", "", raw)
        return "$$\n" + body.strip() + "\n$$"
    if kind == "verbatim":
        body = re.sub(r"\A\\begin\{\w+\}(?:\[[^\]]*\])?\n?|\n?\\end\{\w+\}\Z", "", raw)
    else:
        body = html.unescape(raw) if kind == "escaped" else raw
        body = html.unescape(TAG.sub("", body))
    return "```\n" + body.strip("\n") + "\n```"


def clean(text: str, costs: Costs | None = None) -> tuple[str, list[str], dict[str, int]]:
    """(clean text, kinds of markup found, counts of what was changed)."""
    blocks = Blocks(text)
    labels = labels_of(blocks, costs)
    if not labels:
        return text, [], {}
    fixes = Fixes()
    junk = boilerplate(blocks.lines, labels["html"]) if "html" in labels else [False] * len(blocks.lines)
    out = []
    for i, line in enumerate(blocks.lines):
        if junk[i]:
            fixes["boilerplate_lines_removed"] = fixes.get("boilerplate_lines_removed", 0) + 1
            continue
        if "markdown" in labels and labels["markdown"][i] and SETEXT.match(line) and out and out[-1].strip():
            out[-1] = "# " + out[-1].strip()
            fixes["markdown_headings_converted"] = fixes.get("markdown_headings_converted", 0) + 1
            continue
        for kind, convert in CONVERT.items():
            if kind in labels and labels[kind][i]:
                line = convert(line, fixes)
        out.append(HIDDEN.sub(lambda m: _code(*blocks.code[int(m.group(1))], fixes), line))
    whole = re.sub(r"[ \t]+\n", "\n", "\n".join(out))
    return re.sub(r"\n{3,}", "\n\n", whole).strip("\n"), sorted(labels), dict(fixes)


def clean_markup(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, clean_text, markup, fixes_applied, original_length, cleaned_length), one row for each row."""

    costs = fitted_costs()

    def run(batches):
        import pandas as pd

        for frame in batches:
            rows = []
            for k, own in zip(frame[key], frame[text]):
                cleaned, kinds, fixes = clean(own, costs) if own else (own, [], {})
                rows.append((k, cleaned, kinds, fixes, len(own or ""), len(cleaned or "")))
            yield pd.DataFrame(rows, columns=[key, "clean_text", "markup", "fixes_applied", "original_length", "cleaned_length"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInPandas(run, f"`{key}` {kind}, clean_text string, markup array<string>, fixes_applied map<string,int>, original_length int, cleaned_length int")


def markup_found(cleaned: DataFrame, key: str = "doc_id") -> DataFrame:
    return cleaned.select(key, F.explode("markup").alias("markup")).distinct()
