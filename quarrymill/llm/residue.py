"""Template residue, filler, error pages and script notices in place of content.

Method: labelled exemplars of residue are kept in an inverted index from features to exemplars. A
passage window of a cell retrieves the exemplars it shares features with; its TF-IDF containment in
the best of them is computed, and a cell mostly covered by contained windows is residue. Windows are
sentences and lines with Latin words and pairs of Chinese characters as features; a cell without
letters and digits is one window of its kinds of marks; a bracketed span is a window of its own
whose one feature is its shape, with slots for the names in it, and one contained window of that
kind makes a cell residue, since an unfilled placeholder is residue anywhere.

Scale: feature frequencies come from all cells, as hashed counts of fixed size; detection is a
narrow pass. Distinct cells of an Arrow batch are scored once.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.text import is_no_value, trim_blanks
from quarrymill.vocab import NO_VALUE, PLACEHOLDER

COUNT_SLOTS = 1 << 18
WINDOW_CONTAINMENT = 0.72
CELL_COVERAGE = 0.6

# Labelled exemplars of residue, one a line. NAME stands for a name in a placeholder.
EXEMPLARS = {
    "placeholder": """
{{ NAME }}
${ NAME }
#{ NAME }
{NAME}
<%= NAME %>
<% NAME %>
%(NAME)s
%(NAME)d
%(NAME)f
[[ NAME ]]
__NAME__
$NAME$
<!-- NAME -->
<NAME>
[insert NAME]
[enter NAME]
[your NAME]
[add NAME]
[此处填写]
[此处填写NAME]
[请填写]
[请填写NAME]
[请输入]
[请输入NAME]
[插入]
[插入NAME]
[待补充]
[NAME待补充]
[待补全]
[NAME待补全]
[待填写]
[NAME待填写]
[待完善]
[NAME待完善]
［待补充］
［NAME待补充］
［待补全］
［NAME待补全］
［待填写］
［NAME待填写］
【请填写】
【请填写NAME】
【请输入】
【请输入NAME】
【待填写】
【待填写NAME】
【NAME待填写】
【此处填写】
【此处填写NAME】
【待补充】
【NAME待补充】
【待补全】
【NAME待补全】
""",
    "filler": """
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum
. - ( ) [ ] _ “ ” + $ ^ ~ ° ☆
xxx
aaa
asdf asdf
asdfgh qwerty
foo bar baz
test test
test text
this is a test
TBD
to be determined
to be announced
TODO
TODO: write this section
FIXME
Coming soon
under construction
Your text here
insert text here
Enter description here
Sample text. Replace before publishing.
Placeholder text, replace me
This is dummy copy for layout only (words).
dummy text
content goes here
no content yet
测试测试
测试文本
测试数据
这是测试内容
文案占位
占位文字
示例文字
此处为示例文字，请替换为正式内容。
这里填写产品介绍，不少于字
请在此处输入内容
请输入内容
请输入文字
内容待更新
内容待补充
待补充
待补全
待完善
待编辑
（略）待编辑补充
暂无内容，稍后补充
暂无数据
暂无介绍
敬请期待
正在建设中
页面建设中
""",
    "error": """
400 STATUS
HTTP Error 500 - STATUS
html head title 404 STATUS /title /head body h1 STATUS /h1 /body /html
error code message STATUS request id q
Oops! STATUS. Go back to the start page.
状态
抱歉，状态（错误代码）
error 状态 retry_after
状态，请秒后重试
HTTP status code error message
error code message detail status request_id trace_id
error failed null exception
Oops! Something went wrong
Sorry, the page you are looking for does not exist
The requested page could not be reached (403).
The requested URL was not found on this server
This page is not available
An unexpected error occurred while loading this section.
An error occurred, please try again later
upstream connect error, reset reason: timeout
upstream connect error or disconnect/reset before headers
Connection timed out after ms
Connection refused
Connection reset by peer
Session expired, please sign in again
Please log in to continue
API quota exceeded for today
Rate limit exceeded, retry later
Access denied
Permission denied
ERROR: query returned no result set
query failed
java.lang.NullPointerException at line
Traceback (most recent call last): File line KeyError
Traceback most recent call last line ValueError TypeError
Exception in thread main
undefined is not a function
您访问的页面不存在
系统繁忙，请稍后再试
系统异常
数据加载失败，点击重试
加载失败，请刷新重试
连接超时，请检查网络后刷新
网络异常，请检查网络
接口返回异常：余额不足
接口调用失败
该内容已被删除或您没有权限查看
您没有权限访问
登录已过期，请重新登录
""",
    "script": """
Please enable JavaScript to view this page.
You need to enable JavaScript to run this app.
noscript You need to allow scripts to run this app. /noscript
This site needs scripts. Turn on JavaScript in your browser and reload.
This site requires JavaScript. Turn on JavaScript in your browser and reload the page.
JavaScript is disabled. Some functions will not work.
JavaScript is required
We are sorry but this viewer does not work properly without javascript enabled.
We're sorry but this app doesn't work properly without JavaScript enabled. Please enable it to continue.
Enable cookies and scripts, then refresh.
Please enable cookies
Your browser does not support scripts
Checking your browser before you proceed ( s)
Checking your browser before accessing
Just a moment... verifying you are not a robot
verify you are human
请启用JavaScript后继续访问
请启用脚本
请开启JavaScript
检测到您关闭了JS，请在浏览器设置中打开
加载中，请稍候……（需允许脚本运行）
您的浏览器不支持脚本或脚本已被禁用
本页面需要开启脚本支持才能显示内容
正在检查您的浏览器，请稍候
""",
}

# What stands for STATUS and 状态 in the exemplars, one exemplar each.
STATUSES = ["Bad Request", "Unauthorized", "Forbidden", "Not Found", "Method Not Allowed", "Request Timeout", "Gone", "Too Many Requests", "Internal Server Error",
            "Bad Gateway", "Service Unavailable", "Gateway Time-out", "Gateway Timeout"]
STATUSES_ZH = ["页面不存在", "服务器内部错误", "服务器错误", "服务暂不可用", "网关错误", "网关超时", "禁止访问", "拒绝访问", "请求过于频繁", "请求超时"]

# Brackets of placeholders: opening, what may stand between, closing.
_BRACKETS = [
    (r"\{\{", r"[^{}]*", r"\}\}"), (r"\$\{", r"[^{}]*", r"\}"), (r"#\{", r"[^{}]*", r"\}"), (r"(?<![_^\\])\{", r"[^{}]*", r"\}"),
    (r"<%=", r"[^<>%]*", r"%>"), (r"<%", r"[^<>%=]*", r"%>"), (r"%\(", r"[^()]*", r"\)[sdf]"), (r"\[\[", r"[^\[\]]*", r"\]\]"),
    (r"__", r"[A-Za-z一-鿿][\w.一-鿿]*?", r"__"), (r"\$", r"[^$\s]+", r"\$"), (r"<!--", r"[^<>]*", r"-->"),
    (r"<", r"[^<>]*", r">"), (r"【", r"[^【】]*", r"】"), (r"\[", r"[^\[\]]*", r"\]"), (r"［", r"[^［］]*", r"］"),
]
_SPAN = re.compile("|".join(f"{a}({b}){c}" for a, b, c in _BRACKETS))
_SPACED = re.compile(r"\{\{|[$#]\{|<%|\[\[|<!--")
_IDENTIFIER = re.compile(r"[A-Za-z_一-鿿][\w.一-鿿]*")
SLOT_CHARACTERS = 40
# Tags of pages, which are no names of placeholders.
TAGS = {
    "p", "br", "hr", "b", "i", "u", "a", "em", "sub", "sup", "div", "span", "html", "head", "body", "title", "noscript", "script", "style", "table",
    "tr", "td", "th", "ul", "ol", "li", "h1", "h2", "h3", "h4", "h5", "h6", "strong", "img", "pre", "code",
}
_MARKS = re.compile(r"[{<\[【$%#_［]")
_WINDOW = re.compile(r"[。！？!?\n]+|(?<=[.;])\s+")
_WORDS = re.compile(r"[a-z]+(?:_[a-z]+)*|[一-鿿]+")
_RUN = re.compile(r"(.)\1{2,}")


def features(text: str) -> list[str]:
    """Latin words and pairs of Chinese characters; a text without either is one feature of its own."""
    out = []
    for run in _WORDS.findall(_RUN.sub(r"\1\1\1", text.lower())):
        if run[0] <= "z" or len(run) == 1:
            out.append(run)
        else:
            out += [run[i : i + 2] for i in range(len(run) - 1)]
    return out


def _slot(feature: str) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(feature) % COUNT_SLOTS


def feature_counts(df: DataFrame, fields: Sequence[str]) -> np.ndarray:
    """Hashed counts of the features of all cells: ``COUNT_SLOTS`` numbers whatever the size of the data."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNT_SLOTS, np.int64)
        for batch in batches:
            for column in batch.columns:
                known = column.dictionary_encode()
                seen = defaultdict(int)
                for code, n in zip(*(x.tolist() for x in np.unique(known.indices.drop_null().to_numpy(), return_counts=True)), strict=True):
                    for f in features(known.dictionary[code].as_py()):
                        seen[f] += n
                for f, n in seen.items():
                    total[_slot(f)] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])

    text = df.select(*[F.col(f"`{f}`").cast("string").alias(f"f{i}") for i, f in enumerate(fields)])
    rows = text.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(COUNT_SLOTS, np.int64)
    counts[rows.slot.to_numpy()] = rows.n.to_numpy()
    return counts


def marks(text: str) -> list[str]:
    """The kinds of punctuation and signs in a text."""
    return sorted({"mark " + unicodedata.category(c) for c in text if not c.isspace()})


def labelled(exemplars: dict[str, str]) -> list[tuple[str, str]]:
    """``(kind, exemplar)``, those with a status once for each."""
    out = []
    for kind, text in exemplars.items():
        for line in filter(None, map(str.strip, text.splitlines())):
            word, values = ("STATUS", STATUSES) if "STATUS" in line else ("状态", STATUSES_ZH)
            out += [(kind, line.replace(word, v)) for v in values] if word in line else [(kind, line)]
    return out


class Shapes:
    """Bracketed spans in normal form: names become slots, the words that exemplars have around them stay."""

    def __init__(self, exemplars: Sequence[str]) -> None:
        words = {w.strip() for line in exemplars for m in [_SPAN.search(line)] if m for w in m[m.lastindex].split("NAME")}
        found = sorted(filter(None, words), key=lambda w: (-len(w), w))
        self.cues = re.compile("|".join(rf"\b{re.escape(w)}\b" if w.isascii() else re.escape(w) for w in found) or "(?!)", re.IGNORECASE)

    def _content(self, text: str, opening: str) -> str | None:
        if self.cues.search(text):
            out, at = "", 0
            for m in self.cues.finditer(text):
                out += ("·" if text[at : m.start()].strip() else "") + m[0].lower()
                at = m.end()
                if len(text[at:]) > SLOT_CHARACTERS or m.start() > SLOT_CHARACTERS:
                    return None
            return out + ("·" if text[at:].strip() else "")
        name = text.strip() if _SPACED.match(opening) else text
        known = _IDENTIFIER.fullmatch(name) and not (opening == "<" and name.lower() in TAGS)
        return "·" if known else None

    def spans(self, text: str) -> Iterator[str]:
        """The shapes of all spans; a span may hold others."""
        at = 0
        while m := _SPAN.search(text, at):
            inner = m[m.lastindex]
            opening, closing = text[m.start() : m.start(m.lastindex)], text[m.end(m.lastindex) : m.end()]
            content = self._content(inner, opening)
            if content:
                yield f"{opening}{content}{closing}"
            at = m.start() + 1


class Index:
    """Inverted index of the exemplars, with TF-IDF weights of the corpus."""

    def __init__(self, counts: np.ndarray, exemplars: dict[str, str] = EXEMPLARS) -> None:
        self.counts, self.total = counts, max(1, int(counts.sum()))
        self.postings: dict[str, set[int]] = defaultdict(set)
        self.kinds: list[str] = []
        lines = labelled(exemplars)
        self.shapes = Shapes([line for kind, line in lines if kind == "placeholder"])
        for kind, line in lines:
            # Filler is repeated, so its end may stand before its start.
            joined = features(line + line) if kind == "filler" else []
            found = list(self.shapes.spans(line.replace("NAME", "name"))) if kind == "placeholder" else [*features(line), *joined] or marks(line)
            for f in found:
                self.postings[f].add(len(self.kinds))
            self.kinds.append(kind)
        self.weights: dict[str, float] = {}

    def weight(self, feature: str) -> float:
        got = self.weights.get(feature)
        if got is None:
            got = math.log(1.0 + self.total / (1.0 + int(self.counts[_slot(feature)])))
            if len(self.weights) < 1 << 16:
                self.weights[feature] = got
        return got

    def window(self, distinct: set[str]) -> tuple[float, str | None]:
        """The weight of a window and the kind of the exemplar that contains it, None if none does."""
        total = sum(map(self.weight, distinct))
        shared: dict[int, float] = defaultdict(float)
        for f in distinct & self.postings.keys():
            weight = self.weight(f)
            for e in self.postings[f]:
                shared[e] += weight
        best = max(shared, key=shared.__getitem__, default=-1)
        return total, self.kinds[best] if best >= 0 and shared[best] >= WINDOW_CONTAINMENT * total else None

    def classify(self, cell: str) -> str | None:
        """The kind of residue a cell is, None for content."""
        if _MARKS.search(cell):
            for shape in self.shapes.spans(cell):
                kind = self.window({shape})[1]
                if kind:
                    return kind
        trimmed = cell.strip()
        if trimmed in NO_VALUE:
            return None
        if not any(c.isalnum() for c in trimmed):
            return self.window(set(marks(trimmed)))[1]
        covered: dict[str, float] = defaultdict(float)
        total = 0.0
        # A covered window has at least WINDOW_CONTAINMENT of its weight in exemplars, a covered cell CELL_COVERAGE
        # of its weight in covered windows: a cell below their product, window by window, is none.
        windows = [found for found in map(set, map(features, _WINDOW.split(cell))) if found]
        known = self.postings.keys()
        shared = sum(self.weight(f) for found in windows for f in found & known)
        least = CELL_COVERAGE * WINDOW_CONTAINMENT * (1.0 - 1e-9)
        if not shared or shared < least * sum(self.weight(f) for found in windows for f in found):
            return None
        for found in windows:
            weight, kind = self.window(found)
            total += weight
            if kind:
                covered[kind] += weight
        if covered and sum(covered.values()) >= CELL_COVERAGE * total:
            return max(covered, key=covered.__getitem__)
        return None


def find_residue(
    df: DataFrame,
    table_name: str,
    fields: Sequence[str],
    key: str = "row_id",
    counts: np.ndarray | None = None,
    exemplars: dict[str, str] = EXEMPLARS,
) -> DataFrame:
    """One row per residue cell: ``table_name, row_id, field_name, kind``.

    Kinds: those of ``exemplars``, of which ``placeholder`` is residue anywhere in a cell. Null, blank and the
    no-value tokens that are no placeholder give no row, nor does content that merely mentions such things.
    """
    counts = feature_counts(df, fields) if counts is None else counts
    shared = df.sparkSession.sparkContext.broadcast((counts, exemplars))

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*shared.value)
        for batch in batches:
            cells = batch.column(2).dictionary_encode()
            kinds = np.array([index.classify(c) for c in cells.dictionary.to_pylist()] or [None], dtype=object)[cells.indices.to_numpy()]
            at = pa.array(np.flatnonzero(kinds != np.array(None)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(kinds[at.to_numpy()], pa.string())], ["row_id", "field_name", "kind"]
            )

    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"`{f}`").cast("string").alias("cell")) for f in fields])
    cells = df.select(F.col(key).cast("long").alias("row_id"), F.explode(pairs).alias("p")).select("row_id", "p.field_name", "p.cell")
    tokens = [t for t in NO_VALUE if t != PLACEHOLDER]
    held = cells.where(~is_no_value(trim_blanks(F.col("cell")), tokens)).mapInArrow(detect, "row_id long, field_name string, kind string")
    return held.select(F.lit(table_name).alias("table_name"), "row_id", "field_name", "kind")
