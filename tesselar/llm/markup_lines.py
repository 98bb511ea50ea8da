"""Line costs for the cuts of problem 5: what lines show, labelled lines, and the classifier fitted on them.

The labelled lines are made here, by a rule: documents in plain prose with
look-alikes of markup, documents with a trace of it, and documents in it
throughout, ``DOCUMENTS`` of them (the bound of the training data). Which line is
in which markup is known as it is written. A logistic regression for each kind
of markup learns from them what each sign is worth. How much neighbours count
(the smoothness of the cut) is chosen on further documents made alike.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache
from html.entities import html5

import numpy as np

#: Documents that the classifier is fitted on, and that the smoothness is chosen on.
DOCUMENTS, HELD_OUT = 2_000, 250
KINDS = ["html", "markdown", "wiki", "latex"]
TAGS = "a|abbr|article|aside|b|blockquote|body|br|caption|center|cite|code|dd|del|details|div|dl|dt|em|figure|figcaption|font|footer|form|h[1-6]|head|header|hr|html|i|iframe|img|input|ins|kbd|label|li|link|main|mark|meta|nav|noscript|ol|option|p|pre|q|s|script|section|select|small|span|strike|strong|style|sub|summary|sup|table|tbody|td|textarea|tfoot|th|thead|title|tr|tt|u|ul|var"
TAG = re.compile(rf"</?(?:{TAGS})(?:[\s/][^<>]*)?>", re.I)
OPEN_TAG = re.compile(rf"<(?:{TAGS})(?:\s+[\w:-]+\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'))+", re.I)
ESCAPED_TAG = re.compile(rf"&lt;/?(?:{TAGS}|!--)\b", re.I)
COMMENT = re.compile(r"<!--.*?(?:-->|$)|<!--|-->|<!DOCTYPE[^>]*>", re.I)
ENTITY = re.compile(r"&(?:([A-Za-z][A-Za-z0-9]{1,31})|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});")
FORMULA = re.compile(r"\$\$[^$]+\$\$|(?<![\w$\\])\$(?=[^\s$])[^$\n]*[^\s$\\]\$(?![\w$])|(?<![\w$\\])\$[^\s$]\$(?![\w$])")
SETEXT = re.compile(r"^\s{0,3}(?:-{3,}|={3,})\s*$")
#: What may be seen in a line, with characters one of which it can't do without; each is a feature (its count, on a log scale) and says nothing by itself about the kind.
SIGNS = {
    "command": (("\\",), re.compile(r"(?<![A-Za-z0-9:\\])\\[A-Za-z]+\*?\s*(?:\[[^\]\n]*\])?\{")),
    "bare_command": (("\\",), re.compile(r"(?<![A-Za-z0-9:])\\(?:begin|end|item|section|maketitle|noindent|newpage|leq|geq|frac|alpha|beta|sum|int|cdot|times|infty|par|medskip|bigskip|hline|toprule|midrule|bottomrule|centering|ldots|dots|LaTeX|TeX)\b")),
    "display": (("\\",), re.compile(r"(?<!\\)\\[\[\]()](?:\s|$)|(?:^|\s)\\[\[(]")),
    "backslash": (("\\",), re.compile(r"\\")),
    "row_end": (("\\",), re.compile(r"\\\\\s*$")),
    "tie": (("~",), re.compile(r"\w~\\")),
    "cells_amp": (("&",), re.compile(r"[^\\]&[^\\]*\\\\|^\s*[^&]+ & [^&]+$")),
    "script": (("{",), re.compile(r"[_^]\{")),
    "formula": (("$",), FORMULA),
    "heading_hash": (("#",), re.compile(r"^\s{0,3}#\s+[^\sa-z](?:.*[^.;,\s])?\s*$")),
    "heading_hashes": (("##",), re.compile(r"^\s{0,3}#{2,6}\s+\S")),
    "hash_item": (("#",), re.compile(r"^\s*#+\s*(?:\S.*[.;,]\s*$|[a-z])")),
    "image": (("![",), re.compile(r"!\[[^\]\n]*\]\([^)\n]*\)")),
    "link": (("](",), re.compile(r"\[[^\[\]\n]+\]\([^()\s]+(?:\s+\"[^\"]*\")?\)")),
    "bold_stars": (("**",), re.compile(r"(?<![\w*])\*\*(?=\S)[^*\n]+?\*\*(?!\w)")),
    "bold_stars_inside": (("**",), re.compile(r"\w\*\*(?=\S)[^*\n]+?\*\*")),
    "bold_bars": (("__",), re.compile(r"(?<![\w_])__(?=\S)[^_\n]*?\s[^_\n]*?__(?![\w_])")),
    "bars_word": (("__",), re.compile(r"(?<![\w_])__(?=\S)[^_\s]+?__(?![\w_])")),
    "code": (("`",), re.compile(r"(?<!`)`[^`\n]+`(?!`)")),
    "table_rule": (("---",), re.compile(r"^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*$")),
    "task": (("[",), re.compile(r"^\s*[-*+]\s+\[[ xX]\]\s")),
    "strike": (("~~",), re.compile(r"~~(?=\S)[^~\n]+?~~")),
    "quote": ((">",), re.compile(r"^\s{0,3}>\s+\S")),
    "bullet": (("-", "+",), re.compile(r"^\s*[-+]\s+\S")),
    "star_bullet": (("*",), re.compile(r"^\s*\*+\s+\S")),
    "numbered": ((".", ")",), re.compile(r"^\s*\d+[.)]\s+\S")),
    "star_word": (("*",), re.compile(r"(?<![\w*])\*[^\s*][^*\n]*\*(?![\w*])")),
    "bar_word": (("_",), re.compile(r"(?<!\w)_[^\s_][^_\n]*_(?!\w)")),
    "piped": (("|",), re.compile(r"^\s*\|.*\|\s*$")),
    "rule": (("---", "***",), re.compile(r"^\s*(?:-{3,}|\*{3,})\s*$")),
    "double_link": (("[[",), re.compile(r"\[\[[^\[\]\n]+\]\]")),
    "template": (("{{",), re.compile(r"\{\{[^{}\n]*\}\}|\{\{\s*\w")),
    "quotes3": (("'''",), re.compile(r"'''(?=[^\s'])[^'\n]+?'''")),
    "quotes2": (("''",), re.compile(r"(?<!')''(?=[^\s'])[^'\n]+?''(?!')")),
    "heading_equals": (("==",), re.compile(r"^\s*(={2,6})\s*[^=\n].*?\1\s*$")),
    "wiki_table": (("|",), re.compile(r"^\s*(?:\{\||\|\}\s*$|\|-+\s*$)")),
    "wiki_item": (("**", ":", ";",), re.compile(r"^\s*(?:\*\*+|[:;]+)\s*\S")),
    "wiki_cell": (("|", "!",), re.compile(r"^\s*[|!]\s*\S")),
    "double_bar": (("||",), re.compile(r"\|\|")),
    "long_rule": (("----",), re.compile(r"^\s*----+\s*$")),
}
INSIDE = ["fence", "inline", "pre", "escaped", "verbatim", "math"]
FEATURES = ["tag", "open_tag", "escaped_tag", "comment", "entity", "setext", *INSIDE, *SIGNS]
AT = {name: i for i, name in enumerate(FEATURES)}
MARKS = re.compile(r"[<>&#*`|\[{\\$'=~_>+:;!-]|^\s*\d+[.)]\s", re.M)


def features(line: str, previous: str, inside: str) -> dict[int, float]:
    """{feature: log2(1 + count)} of a line; ``inside`` is the kind of code block set aside in it, if any."""
    counts: dict[str, int] = {}
    if "<" in line or "&" in line or "-->" in line:
        counts = {"tag": len(TAG.findall(line)), "open_tag": len(OPEN_TAG.findall(line)), "comment": len(COMMENT.findall(line))}
        counts["entity"] = sum(1 for m in ENTITY.finditer(line) if m.group(1) is None or m.group(1) + ";" in html5)
        counts["escaped_tag"] = len(ESCAPED_TAG.findall(line)) if "&lt;" in line else 0
    if inside:
        counts[inside] = 1
    if SETEXT.match(line) and previous.strip() and not previous.lstrip().startswith(("|", "-", "*", "=")) and previous.rstrip()[-1] not in ".,;" and "  " not in previous.strip():
        counts["setext"] = 1
    if MARKS.search(line):
        for name, (needs, pattern) in SIGNS.items():
            for mark in needs:
                if mark in line:
                    counts[name] = sum(1 for _ in pattern.finditer(line))
                    break
    return {AT[name]: float(np.log2(1 + n)) for name, n in counts.items() if n}


class Costs:
    """The classifier: what it costs to call a line on or off, for each kind, and the smoothness of the cuts."""

    def __init__(self, weights: np.ndarray, smooth: float):
        self.weights, self.smooth = weights, smooth  # weights: kind x (features, then the constant)

    def margins(self, lines: list[dict[int, float]]) -> list[list[float]]:
        """For each kind the log odds of each line; all together cheap, as most lines show little."""
        rows = []
        for w in self.weights.tolist():
            rows.append([w[-1] + sum(w[i] * x for i, x in line.items()) for line in lines])
        return rows


def fit(lines: list[dict[int, float]], labels: np.ndarray, ridge: float = 0.03, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression, by Newton steps."""
    x = np.zeros((len(lines), len(FEATURES) + 1))
    x[:, -1] = 1
    for row, line in zip(x, lines):
        for i, v in line.items():
            row[i] = v
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty), x.T @ (p - labels) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Writer:
    """Makes labelled documents: lists of (lines, kinds of markup they are in)."""

    SYLLABLES = "ba re ti lo mun sa der ko vi pal ne tor is an eu fra gol hi jun ce".split()

    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.vocabulary = ["".join(self.rng.choice(self.SYLLABLES) for _ in range(self.rng.randrange(1, 5))) for _ in range(300)]

    def word(self) -> str:
        return self.rng.choice(self.vocabulary)

    def some(self, least: int, most: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randrange(least, most)))

    def look_alike(self) -> str:
        w, n = self.word, self.rng.randrange(1, 900)
        return self.rng.choice(
            [f"${n} million", f"costs ${n} or ${n + 1}", f"€{n}", f"p < 0.0{n}", f"n > {n} and m < {n + 5}", f"C:\\data\\{n}", f"D:\\{w()}\\{w()}", f"[{n}]", f"[{n}, {n + 1}]", f"({n})", "R&D", "AT&T", f"{n} * {n} * 3", f"{{{w()}}}", f"{w()}_{w()}_v{n}", f"#{n}", f"{n}*", f"{w()}/{w()}", f"~{n}", f"{n} ^ 2", "__init__", f"__{w()}__", f"2**{n}**2", f"{w()}''s", f"<{n} mg", f"{w()} -- {w()}", f"{w()} & {w()}", f"* {w()}", f"*{w()}*", f"_{w()}_", f"{w()}|{w()}", f"{n} <> {n}", "a && b", f"x = {n} x {n}", f"\\{w()}\\{w()}", f"[{n}] ({w()})", f"{w()} = {w()} == {w()}", f"e.g. {w()}; {w()}"]
        )

    def inline(self, kind: str) -> str:
        w, n, rng = self.word, self.rng.randrange(1, 99), self.rng
        if kind == "html":
            tag = rng.choice(["b", "i", "em", "strong", "u", "sup", "sub", "span", "code", "small"])
            return rng.choice([f"<{tag}>{w()}</{tag}>", f"<{tag}>{self.some(1, 4)}</{tag}>", f'<a href="https://{w()}.example/{n}">{w()}</a>', f'<span class="c{n}">{w()}</span>', "<br>", "<br/>", f"{w()} &amp; {w()}", f"{w()}&nbsp;{w()}", f"{w()}&#8217;s", f"&quot;{w()}&quot;", f"&lt;b&gt;{w()}&lt;/b&gt;", f"&lt;p&gt;{w()}", f"<!-- {w()} -->", f"{w()} &lt; {n}", f"caf&eacute; &#x2014; {w()}", "</p>", f'<img src="{w()}.png" alt="{w()}">'])
        if kind == "markdown":
            return rng.choice([f"**{w()}**", f"**{self.some(2, 4)}**", f"__{self.some(2, 4)}__", f"`{w()}`", f"[{w()}]({w()}.example/{n})", f"[{self.some(2, 4)}](https://{w()}.example)", f"![{w()}]({w()}.png)", f"![](images/{w()}{n}.png)", f"~~{w()}~~"])
        if kind == "wiki":
            return rng.choice([f"[[{w()}]]", f"[[{w()}|{self.some(1, 3)}]]", f"{{{{cite|title={w()}|year={n}}}}}", f"'''{w()}'''", f"''{self.some(1, 3)}''", f"{{{{{w()}}}}}", f"{{{{math|{w()[0]} {{{{=}}}} {n}}}}}", f"[[File:{w()}.png|thumb|{w()}]]"])
        return rng.choice([f"$x_{{{n}}} = {n}$", f"${w()[0]} = {n}^{{2}}$", f"$n = {n}$", f"$$y_{{i}} = {n}$$", f"\\emph{{{w()}}}", f"\\textbf{{{self.some(1, 3)}}}", f"{w()}~\\cite{{{w()}{n}}}", f"\\ref{{sec:{n}}}", f"\\footnote{{{self.some(2, 5)}}}", f"$\\alpha \\leq {n}$", f"\\( x = {n} \\)", f"\\url{{{w()}}}", f"{w()} \\ldots {w()}"])

    def sentence(self, *inside: str) -> str:
        parts = [self.some(3, 9).capitalize(), *(p for x in inside for p in (x, self.some(2, 7)))]
        return " ".join(parts) + self.rng.choice([".", ".", ";", ""])

    def plain(self) -> list[str]:
        rng = self.rng
        pick = rng.random()
        if pick < 0.6:
            return [" ".join(self.sentence(*([self.look_alike()] if rng.random() < 0.4 else [])) for _ in range(rng.randrange(1, 4)))]
        if pick < 0.7:
            return [f"- {self.some(1, 6)}" for _ in range(rng.randrange(2, 6))]
        if pick < 0.78:
            return [f"{i + 1}{rng.choice('.)')} {self.some(1, 6)}" for i in range(rng.randrange(1, 5))]
        if pick < 0.84:
            return [rng.choice([self.some(1, 4).upper(), f"{rng.randrange(9)}. {self.some(1, 4).title()}", f"Article {rng.randrange(99)}"])]
        if pick < 0.9:
            return [f"    def {self.word()}(x):", f"        if x < {rng.randrange(9)} and x > 0:", f"            return x * {rng.randrange(9)}", "        return 0"]
        if pick < 0.93:
            bar = rng.choice(["", "| "])
            return [bar + f"{self.word()} | {self.word()} | {rng.randrange(99)}" + bar[::-1] for _ in range(rng.randrange(2, 5))]
        if pick < 0.96:
            return [f"* {self.some(1, 6)}" for _ in range(rng.randrange(2, 5))]
        return [rng.choice([self.look_alike(), "-" * rng.randrange(3, 30), f"# {self.some(1, 4)}"])]

    def block(self, kind: str) -> list[str]:
        rng, w, n = self.rng, self.word, self.rng.randrange(1, 99)
        text = lambda: self.sentence(*([self.inline(kind)] if rng.random() < 0.5 else []))
        title, rows = self.some(1, 4).title(), rng.randrange(2, 5)
        if kind == "html":
            return rng.choice([[f"<h{rng.randrange(1, 5)}>{title}</h2>"], [f"<p>{text()}</p>"], [f'<p class="c{n}">{text()}'], ["<p>", text(), "</p>"], ["<ul>", *(f"<li>{self.some(1, 4)}</li>" for _ in range(rows)), "</ul>"], [f'<div class="{w()}">', text(), "</div>"], ["<table>" + "".join(f"<tr><td>{w()}</td><td>{n}</td></tr>" for _ in range(rows)) + "</table>"], [f"<pre><code>{w()} < {w()}</code></pre>"], [f"&lt;h2&gt;{title}&lt;/h2&gt;"], [f"&lt;p&gt;{text()}&lt;/p&gt;"], ["<!-- " + self.some(1, 4) + " -->"], ["<hr>"], [f"<script>var {w()} = {n};</script>"]])
        if kind == "markdown":
            return rng.choice([["#" * rng.randrange(1, 5) + f" {title}"], [title, rng.choice("-=") * 8], [f"```{w()}\n{w()} = [{n}]\n```"], [f"- [{rng.choice(' x')}] {self.some(1, 5)}" for _ in range(rows)], [f"> {text()}"], [f"| {w()} | {w()} |", "|---|---|", *(f"| {w()} | {n} |" for _ in range(rows))], [f"{rng.choice('-*+')} {text()}" for _ in range(rows)], [f"{i + 1}. {text()}" for i in range(rows)], [f"*{self.some(1, 3)}* " + text()], [self.inline("markdown")], ["---"]])
        if kind == "wiki":
            depth = "=" * rng.randrange(2, 5)
            return rng.choice([[f"{depth} {title} {depth}"], [f"{'*' * rng.randrange(1, 3)} {text()}" for _ in range(rows)], [f"# {self.some(2, 8)}" for _ in range(rows)], ['{| class="wikitable"', "|-", f"! {w()} !! {w()}", *(x for _ in range(rows) for x in ("|-", f"| {w()} || {n}")), "|}"], [f"{{{{{title}|{w()}={n}}}}}"], [f": {text()}"], [f"; {w()}"], [f"[[Category:{title}]]"], [self.inline("wiki")]])
        return rng.choice([[f"\\{rng.choice(['section', 'subsection', 'section*'])}{{{title}}}"], ["\\begin{itemize}", *(f"\\item {text()}" for _ in range(rows)), "\\end{itemize}"], ["\\begin{tabular}{ll}", *(f"{w()} & {n} \\\\" for _ in range(rows)), "\\hline", "\\end{tabular}"], [f"\\begin{{verbatim}}\n{w()} < {n}\n\\end{{verbatim}}"], [f"\\begin{{equation}}\nx = {n}\n\\end{{equation}}"], [f"\\[ x = {n} \\]"], [f"$$x = {n}$$"], ["\\maketitle"], [f"\\label{{sec:{n}}}"], [f"\\section{{{title}}}\\label{{sec:{n}}}"]])

    def trace(self, kind: str) -> str:
        """One line that is surely in that markup, among plain ones."""
        rng, w = self.rng, self.word
        pick, mark = rng.random(), self.inline(kind)
        if pick < 0.55:
            return self.sentence(*([self.look_alike(), mark] if rng.random() < 0.5 else [mark]))
        if pick < 0.65:
            return f"- {w()} {mark} {w()}"
        if pick < 0.75:
            return f"    {mark} if x < {rng.randrange(9)}:"
        title = self.some(1, 4).title()
        return rng.choice({"html": [f"<h2>{title}</h2>", f"<p>{self.sentence()}</p>", "<hr>", f"&lt;p&gt;{title}"], "markdown": [f"# {title}", f"## {title}", f"> {self.sentence()}", f"```\n{w()}\n```", f"- [x] {title}"], "wiki": [f"== {title} ==", f"=== {title} ===", f"[[Category:{title}]]", f"{{{{{title}|{w()}=1}}}}", "{|"], "latex": [f"\\section{{{title}}}", f"\\begin{{{w()}}}", "\\maketitle", "$$x = 1$$", f"\\subsection{{{title}}}\\label{{sec:{w()}}}"]}[kind])

    def document(self) -> list[tuple[str, set[str]]]:
        rng = self.rng
        out: list[tuple[str, set[str]]] = []
        pick = rng.random()
        own = [] if pick < 0.35 else rng.sample(KINDS, 2 if rng.random() < 0.2 else 1)
        trace = pick < 0.6
        traces = {rng.randrange(8) for _ in range(rng.randrange(1, 3))} if trace and own else set()
        for i in range(8):
            if not own or trace:
                if i in traces:
                    kind = rng.choice(own)
                    out.append((self.trace(kind), {kind}))
                else:
                    out += [(line, set()) for line in self.plain()]
            else:
                kind = rng.choice(own)
                pick = rng.random()
                if pick < 0.55:
                    out += [(line, {kind}) for line in self.block(kind)]
                elif pick < 0.8:
                    out.append((self.sentence(self.inline(kind), *([self.inline(kind)] if rng.random() < 0.3 else [])), {kind}))
                else:
                    out += [(line, set()) for line in self.plain()[:1]]
            out.append(("", set()))
        return out


def labelled(seed: int, documents: int, blocks) -> list[tuple[list[str], list[dict[int, float]], list[set[str]]]]:
    """(lines, their features, kinds they are in) of ``documents`` documents; ``blocks`` cuts a text into lines."""
    writer, out = Writer(seed), []
    while len(out) < documents:
        rows = writer.document()
        cut = blocks("\n".join(line for line, _ in rows))
        if len(cut.lines) == len(rows):  # else a construct went over the end of a line and labels don't fit
            out.append((cut.lines, [features(x, cut.lines[i - 1] if i else "", cut.inside(x)) for i, x in enumerate(cut.lines)], [kinds for _, kinds in rows]))
    return out


@lru_cache(1)
def fitted_costs() -> Costs:
    """The classifier and the smoothness, always the same: made from seeds."""
    from tesselar.llm.p05_markup import Blocks, label_lines

    made = labelled(1, DOCUMENTS, Blocks)
    full = [(f, kinds) for lines, rows, marks in made for line, f, kinds in zip(lines, rows, marks) if line.strip()]
    weights = np.array([fit([f for f, _ in full], np.array([k in kinds for _, kinds in full], float)) for k in KINDS])
    held, best = labelled(2, HELD_OUT, Blocks), None
    for smooth in (0.1, 0.2, 0.4, 0.7, 1.0, 1.4):
        costs, right = Costs(weights, smooth), (0, 0)
        for lines, rows, marks in held:
            got = label_lines(lines, rows, costs)
            right = right[0] + (set(got) == set().union(*marks)), right[1] + sum((k in got and got[k][i]) == (k in kinds) for i, kinds in enumerate(marks) for k in KINDS)
        if best is None or right > best[0]:  # documents with the right kinds, then lines
            best = right, costs
    return best[1]
