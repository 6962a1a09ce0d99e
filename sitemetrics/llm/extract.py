"""Main text of web pages: gradient-boosted trees over the nodes of the document tree, decoded over the hierarchy.

A page is parsed into its block elements; inline elements belong to the block around them. Each node has features: tag and
attribute tokens of the node and of its ancestors by group, depth, text and link characters of the subtree and their density, sentence marks,
and statistics among siblings. The trees give the probability that a node is main text. Decoding then finds the
best assignment of `in`, `out` and `mixed` to all nodes where an `out` node has only `out` nodes below it and an `in` node no `mixed` ones, so an
ancestor and a descendant never contradict each other. The text of `in` nodes is put out, block by block, in page order.

The model is trained on at most about SAMPLE pages drawn by a digest of the id. Their labels come from explicit structure (article and main
against nav, footer, aside, form and the like); each page is also used in altered forms in which these elements are renamed to
div with telling attributes and in which comments, sidebars, notices and forms made of other pages' text are put in, so that the trees learn from
attribute tokens and densities too. Pages are extracted whole, by Arrow batches, without a shuffle.

Defined cases: a null or empty page gives an empty text; unclosed, misnested and cut-off markup is read as far as it goes; text outside any
element belongs to the root; without any page to learn from the text is that of article and main elements; repeated rows are handled
alike; an empty table gives an empty result; n_chars counts code points.
"""

import html
import math
import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemetrics.llm.common import small_batches

#: Pages learned from, at most; altered forms of each; trees, their depth, learning rate; bins of a feature.
SAMPLE, FORMS, TREES, DEPTH, RATE, BINS = 240, 3, 60, 4, 0.3, 32

# Element names.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style noscript template title head textarea select option svg iframe object canvas audio video datalist".split())
RAW = ("script", "style", "textarea", "title", "iframe", "noscript")
#: Without an end tag these take the rest of the page; of the others only the start tag is skipped then.
TO_THE_END = ("script", "style", "textarea", "title")
BLOCK = set("""address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset
h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul""".split())
TAGS = {"content": "article main", "title": "h1", "heading": "h2 h3 h4 h5 h6", "paragraph": "p pre blockquote", "list": "ul ol dl menu dir", "item": "li dd dt",
        "nav": "nav", "header": "header hgroup", "footer": "footer address", "aside": "aside", "form": "form fieldset button dialog search legend",
        "table": "table tbody thead tfoot tr td th", "figure": "figure figcaption", "section": "section div center details"}
# Words found in class, id, role and the like.
TOKENS = {"content": "content article main post entry story body text articlebody prose page",
          "nav": "nav navigation navbar menu breadcrumb breadcrumbs toc pagination pager tabs skip",
          "header": "header head masthead banner topbar branding logo byline meta",
          "footer": "footer foot bottom copyright colophon contentinfo legal",
          "aside": "sidebar side aside complementary widget related recommended rail popular trending more tags",
          "ad": "ad ads advert advertisement advertising sponsor sponsored promo promotion promoted adsense dfp",
          "comment": "comment comments reply replies respond disqus discussion thread commentlist feedback",
          "notice": "notice cookie cookies consent gdpr alert warning popup modal overlay toast paywall announcement",
          "form": "form search login signup subscribe newsletter register share social sharing follow contact"}
_TAG_GROUP = {t: i for i, names in enumerate(TAGS.values()) for t in names.split()}
_TOKEN_GROUP = {t: i for i, names in enumerate(TOKENS.values()) for t in names.split()}
_N_TAGS, _N_TOKENS = len(TAGS), len(TOKENS)
# A start of one of these ends an open element of the second kind, unless one of the third is between.
_CLOSES = {t: ("p", ()) for t in BLOCK - {"button"}} | {"li": ("li", ("ul", "ol", "menu")), "dd": ("dd", ("dl",)), "dt": ("dt", ("dl",)),
                                                       "tr": ("tr", ("table",)), "td": ("td", ("tr", "table")), "th": ("th", ("tr", "table"))}

STAMP = "stamp-of-label="
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""(?:class|id|role|itemprop|aria-label|data-[a-z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "parent", "depth", "tokens", "children", "parts", "chars", "linked", "marks", "hidden", "stamp")

    def __init__(self, tag, parent, attrs=""):
        self.tag, self.parent, self.depth = tag, parent, 0 if parent is None else parent.depth + 1
        self.tokens = {p.lower() for m in _NAMED.finditer(attrs) for p in _PIECE.findall(m[1] or m[2] or m[3] or "")} if attrs else ()
        self.children, self.parts, self.hidden = [], [], "hidden" in attrs and bool(re.search(r"(?:\s|^)hidden(?:\s|=|$)", attrs))
        self.chars = self.linked = self.marks = 0
        self.stamp = attrs[attrs.index(STAMP) + len(STAMP)] if STAMP in attrs else ""   # label that training gave


def _end_of(page: str, name: str, at: int) -> int | None:
    """Where the hidden element that starts before `at` ends, elements of its name inside it included; None where it does not."""
    if name == "option":   # ends at the next one, or with its list
        end = _OPTION_END.search(page, at)
        return end and (end.end() if end[0].lower().startswith("</option") else end.start())
    depth = 1
    for tag in re.compile(rf"<(/?){name}(?=[\s/>])[^>]*>", re.I).finditer(page, at):
        depth += -1 if tag[1] else int(not tag[0].endswith("/>"))
        if not depth:
            return tag.end()
    return None


_OPTION_END = re.compile(r"</option\s*>|<(?=option[\s>])|<(?=/?(?:select|optgroup|datalist)[\s>])", re.I)


def parse(page: str) -> list[Node]:
    """Block nodes in page order, parents first. Text is kept in `parts` as (place in the page, text)."""
    root = Node("html", None)
    nodes, node, at, link, place = [root], root, 0, 0, 0
    length, endless = len(page), set()

    def text(raw):
        nonlocal place
        if raw:
            if "&" in raw:
                raw = html.unescape(raw)
            node.parts.append((place, raw))
            if not raw.isspace():
                node.chars += len(raw)
                node.marks += raw.count(".") + raw.count(",") + raw.count("?")
                if link:
                    node.linked += len(raw)
            place += 1
    while at < length:
        found = _TOKEN.search(page, at)
        if found is None:
            text(page[at:])
            break
        text(page[at:found.start()])
        at = found.end()
        name = found[2] or found[5]
        if name is None:
            continue
        name, closing, attrs = name.lower(), found[1] or found[4], found[3] or found[6] or ""
        if closing:
            if name == "a":
                link = max(0, link - 1)
            elif name in BLOCK:
                other = node
                while other is not None and other.tag != name:
                    other = other.parent
                if other is not None and other.parent is not None:
                    node = other.parent
                elif name == "p":
                    place += 1
            continue
        if name in RAW:
            end = None if name in endless else re.compile(rf"</{name}", re.I).search(page, at)
            if end is not None:
                stop = page.find(">", end.end())
                at = length if stop < 0 else stop + 1
            elif name in TO_THE_END:
                break
            endless |= {name} if end is None else set()
            continue
        if name == "a":
            link += not attrs.rstrip().endswith("/")
        elif name in HIDDEN and name not in ("head",) and not attrs.rstrip().endswith("/"):
            # Content of the other hidden elements: up to their end. A search that finds none is not made again.
            end = None if name in endless else _end_of(page, name, at)
            if end is None:
                endless.add(name)
            else:
                at = end
        elif name == "br":
            text("\n")
        elif name in BLOCK and name not in ("html", "body"):
            closes = _CLOSES.get(name)
            if closes:
                other = node
                while other.parent is not None and other.tag != closes[0] and other.tag not in closes[1] and other.tag in ("p", "li", "dd", "dt", "tr", "td", "th"):
                    other = other.parent
                if other.tag == closes[0] and other.parent is not None:
                    node = other.parent
            link = 0 if node.tag in ("html",) else link
            child = Node(name, node, attrs)
            node.children.append((place, child))
            place += 1
            nodes.append(child)
            node = child
    return nodes


def features(nodes: list[Node]) -> np.ndarray:
    n = len(nodes)
    index = {id(x): i for i, x in enumerate(nodes)}
    parent = [index[id(x.parent)] if x.parent is not None else -1 for x in nodes]
    chars, linked, marks = [x.chars for x in nodes], [x.linked for x in nodes], [x.marks for x in nodes]
    size, paragraphs = [1] * n, [int(x.tag == "p") for x in nodes]
    for i in range(n - 1, 0, -1):
        p = parent[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        marks[p] += marks[i]
        size[p] += size[i]
        paragraphs[p] += paragraphs[i]
    width = 2 * (_N_TAGS + _N_TOKENS) + 14
    out = np.zeros((n, width), np.float32)
    total, above_at = max(1, chars[0]), _N_TAGS + _N_TOKENS
    for i, x in enumerate(nodes):
        row = out[i]
        if parent[i] >= 0:
            np.maximum(out[parent[i], :above_at], out[parent[i], above_at: 2 * above_at], out=row[above_at: 2 * above_at])
        group = _TAG_GROUP.get(x.tag)
        if group is not None:
            row[group] = 1
        for token in x.tokens:
            group = _TOKEN_GROUP.get(token)
            if group is not None:
                row[_N_TAGS + group] = 1
        p = nodes[parent[i]] if parent[i] >= 0 else None
        brothers = len(p.children) if p else 1
        row[2 * above_at:] = (x.depth, math.log1p(chars[i]), linked[i] / max(1, chars[i]), chars[i] / size[i], marks[i] * 50 / max(1, chars[i]),
                              math.log1p(size[i]), len(x.children), brothers, chars[i] / total, i / n, paragraphs[i], x.hidden,
                              chars[i] / max(1, chars[parent[i]]) if p else 1.0, math.log1p(x.chars))
    return out


# Training labels from explicit structure.
_IN, _OUT = {"article", "main"}, {"nav", "footer", "aside", "form", "header", "button", "dialog"}
_AWAY = {"ad", "comment", "notice", "aside", "nav", "footer", "form"}


def labels(nodes: list[Node]) -> list[int]:
    """1 for nodes inside article or main and in nothing that is set apart; 0 for the rest."""
    groups = list(TOKENS)
    state: dict[int, int] = {}
    out = []
    for x in nodes:
        inside = state.get(id(x.parent), 0)
        named = {groups[_TOKEN_GROUP[t]] for t in x.tokens if t in _TOKEN_GROUP}
        if x.stamp:
            inside = 1 if x.stamp == "1" else -1
        elif inside == -1 or x.tag in _OUT and not (x.tag == "header" and inside == 1) or named & _AWAY or x.hidden:
            inside = -1
        elif x.tag in _IN or named & {"content"} and x.tag != "p":
            inside = 1
        state[id(x)] = inside
        out.append(int(inside == 1))
    return out


def altered(page: str, others: list[str], rnd: random.Random) -> str:
    """The page with its telling elements renamed and with parts put in that do not belong to the main text."""
    def words(key):
        return rnd.choice(TOKENS[key].split())

    def rename(tag, key):
        nonlocal page
        token = words(key)
        kind = rnd.choice(['class="%s"', 'id="%s"', 'class="site-%s"', 'class="%s-box"']) % token
        holder = rnd.choice(["div", "section"])
        page = re.sub(rf"<{tag}(?=[\s>])", f"<{holder} {kind}", page)
        page = page.replace(f"</{tag}>", f"</{holder}>")
    # The labels are stamped on the elements first, so that they stay when the telling markup goes.
    begin, end = page.find("<article"), page.find("</article>")
    if begin >= 0:
        end = len(page) if end < 0 else end
        body = re.sub(r"<(p|h1)>", rf'<\1 {STAMP}1>', page[begin:end])
        if rnd.random() < 0.5:
            body = re.sub(rf"<p {STAMP}1>([^<]*)</p>", lambda m: m[0] if rnd.random() < 0.7 else rnd.choice([
                f"<ul {STAMP}1><li>{m[1]}</li><li>{m[1][:60]}</li></ul>", f"<blockquote {STAMP}1>{m[1]}</blockquote>", f"<h2 {STAMP}1>{m[1][:40]}</h2>",
                f"<div {STAMP}1>{m[1]}</div>", f"<table {STAMP}1><tr><td>{m[1]}</td><td>{m[1][:20]}</td></tr></table>", f" {m[1]} "]), body)
        if rnd.random() < 0.4:
            body = re.sub(rf"(<h1 {STAMP}1>)([^<]*)", lambda m: m[1] + m[2][:rnd.randint(1, 25)], body)
        body = body.replace("<article", f"<article {STAMP}1", 1)
        page = page[:begin] + body + page[end:]
        way = rnd.random()
        if way < 0.25:
            page = page.replace(f"<article {STAMP}1>", "").replace("</article>", "")
        elif way < 0.8:
            rename("article", "content")
        if rnd.random() < 0.3:
            holder = f'<div id="{rnd.choice(["main", "page", "wrapper", "container"])}">'
            page = page.replace("<body>", "<body>" + holder)
    if rnd.random() < 0.7:
        rename("nav", "nav")
    if rnd.random() < 0.7:
        rename("footer", "footer")
    rest = [s for o in others for s in re.findall(r"<p>([^<]{20,600})", o)] or ["A line of text."]

    def lines(n, tag="p"):
        return "".join(f"<{tag}>{rnd.choice(rest)[:rnd.randint(15, 400)]}</{tag}>" for _ in range(n))

    def links(n):
        return "<ul>" + "".join(f'<li><a href="#">{rnd.choice(rest)[:rnd.randint(5, 40)]}</a></li>' for _ in range(n)) + "</ul>"
    def comments():
        holder = rnd.choice(["section", "div"])
        body = "".join(f'<div class="comment">{lines(rnd.randint(1, 2))}</div>' for _ in range(rnd.randint(1, 4)))
        return f'<{holder} {rnd.choice(["id", "class"])}="{words("comment")}"><h3>Comments</h3>{body}</{holder}>'
    extra = {"comment": comments,
             "aside": lambda: (rnd.choice(["<aside>", f'<aside class="{words("aside")}">']) if rnd.random() < 0.6 else f'<div class="{words("aside")}">')
             + rnd.choice([lines(rnd.randint(1, 3)), rnd.choice(rest)[:rnd.randint(20, 400)], ""]) + rnd.choice([links(rnd.randint(2, 6)), ""]),
             "notice": lambda: f'<div class="{words("notice")}">{lines(1)}<button>OK</button></div>',
             "ad": lambda: f'<div class="{words("ad")}">{lines(1) if rnd.random() < 0.5 else rnd.choice(rest)[:200]}</div>',
             "form": lambda: '<form' + rnd.choice(["", " class=" + words("form")]) + f'>{rnd.choice(["", rnd.choice(rest)[:120]])}<label>{rnd.choice(rest)[:30]}</label><input name="q"><button>Go</button></form>',
             "header": lambda: f'<header class="{words("header")}"><h2>{rnd.choice(rest)[:30]}</h2>{links(3)}</header>'}
    for key in rnd.sample(sorted(extra), rnd.randint(1, 4)):
        part = extra[key]()
        if key == "aside":
            part += "</aside>" if part.startswith("<aside") else "</div>"
        part = re.sub(r"^<(\w+)", rf"<\1 {STAMP}0", part)
        # At one of the seams between elements of the page's outermost level or of its text.
        seams = [m.end() for m in re.finditer(r"</nav>|</p>|<body>|</article>|</section>", page)]
        if seams:
            at = rnd.choice(seams)
            page = page[:at] + part + page[at:]
    return page


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees=TREES, depth=DEPTH, rate=RATE):
    """Boosted regression trees for the logistic loss, grown level by level on histograms. Returns (bias, [(feature, edge, value)])."""
    edges = []
    binned = np.zeros(x.shape, np.int64)
    for f in range(x.shape[1]):
        cut_at = np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1]))
        edges.append(cut_at)
        binned[:, f] = np.searchsorted(cut_at, x[:, f], "left")
    mean = float(np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3))
    bias = math.log(mean / (1 - mean))
    margin, model = np.full(len(y), bias), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (y - p), weight * p * (1 - p)
        leaf = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(2 ** depth - 1, np.int32), np.full(2 ** depth - 1, np.inf, np.float32)
        for level in range(depth):
            first, count = 2 ** level - 1, 2 ** level
            best = np.full(count, 1e-6)
            for f in range(x.shape[1]):
                if not len(edges[f]):
                    continue
                key = leaf * (BINS + 1) + binned[:, f]
                hg = np.bincount(key, g, count * (BINS + 1)).reshape(count, -1).cumsum(axis=1)
                hh = np.bincount(key, h, count * (BINS + 1)).reshape(count, -1).cumsum(axis=1)
                tg, th = hg[:, -1:], hh[:, -1:]
                gain = hg ** 2 / (hh + 1) + (tg - hg) ** 2 / (th - hh + 1) - tg ** 2 / (th + 1)
                gain = gain[:, :len(edges[f])]
                at = gain.argmax(axis=1)
                better = gain[np.arange(count), at] > best
                for k in np.flatnonzero(better):
                    best[k] = gain[k, at[k]]
                    feature[first + k], threshold[first + k] = f, edges[f][at[k]]
            here = first + leaf
            leaf = 2 * leaf + (x[np.arange(len(y)), feature[here]] > threshold[here])
        sg, sh = np.bincount(leaf, g, 2 ** depth), np.bincount(leaf, h, 2 ** depth)
        value = (rate * sg / (sh + 1)).astype(np.float32)
        margin += value[leaf]
        model.append((feature, threshold, value))
    return bias, model


def probability(model, x: np.ndarray) -> np.ndarray:
    bias, trees = model
    margin, rows = np.full(len(x), bias), np.arange(len(x))
    for feature, threshold, value in trees:
        at = np.zeros(len(x), np.int64)
        for _ in range(int(math.log2(len(value)))):
            at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
        margin += value[at - len(feature)]
    return 1 / (1 + np.exp(-margin))


def decode(nodes: list[Node], p) -> list[bool]:
    """Whether each node is `in`, by the best consistent assignment. A node's own weight grows with its own text."""
    n = len(nodes)
    index = {id(x): i for i, x in enumerate(nodes)}
    up = [index[id(x.parent)] if x.parent is not None else -1 for x in nodes]
    best_in, best_out, best_mixed = [0.0] * n, [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        x, q = nodes[i], min(max(float(p[i]), 1e-4), 1 - 1e-4)
        weight = 0.2 + math.log1p(x.chars)
        best_in[i] += weight * math.log(q)
        best_out[i] += weight * math.log(1 - q)
        best_mixed[i] += -1e9 if not x.children else -(0.3 + (weight * 0.9 if x.chars else 0.0))
        if up[i] >= 0:
            best_in[up[i]] += max(best_in[i], best_out[i])
            best_out[up[i]] += best_out[i]
            best_mixed[up[i]] += max(best_in[i], best_out[i], best_mixed[i])
    state = [0] * n   # 1 in, 0 out, 2 mixed
    for i in range(n):
        above = state[up[i]] if i else 2
        options = [(best_out[i], 0)]
        if above:
            options.append((best_in[i], 1))
        if above == 2:
            options.append((best_mixed[i], 2))
        state[i] = max(options)[1]
    return [s == 1 for s in state]


def gather(nodes: list[Node], chosen) -> str:
    """Text of the chosen nodes: a block for each stretch of a node's text between its child blocks."""
    blocks = []
    for x, on in zip(nodes, chosen):
        if not on or not x.parts:
            continue
        seams = [place for place, _ in x.children]
        k, first, held = 0, 0, []
        for place, raw in x.parts:
            if k < len(seams) and seams[k] < place:
                while k < len(seams) and seams[k] < place:
                    k += 1
                blocks.append((first, held))
                held = []
            if not held:
                first = place
            held.append(raw)
        blocks.append((first, held))
    found = ((first, " ".join("".join(held).split())) for first, held in blocks)
    return "\n\n".join(t for _, t in sorted(b for b in found if b[1]))


def main_texts(pages, model) -> list[str]:
    trees = [parse(page or "") for page in pages]
    if model is None:
        return [gather(t, labels(t)) for t in trees]
    rows = [features(t) for t in trees]
    p = probability(model, np.concatenate(rows)) if rows else []
    out, at = [], 0
    for nodes in trees:
        out.append(gather(nodes, decode(nodes, p[at: at + len(nodes)])))
        at += len(nodes)
    return out


def learn(sample: list[tuple[int, str]]):
    """Model from (id, page) rows."""
    if not sample:
        return None
    sample = sorted(sample, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    xs, ys, ws = [], [], []
    for i, (ident, page) in enumerate(sample):
        rnd = random.Random(f"page {ident}")
        others = [sample[rnd.randrange(len(sample))][1] for _ in range(2)]
        for form in (page, *(altered(page, others, rnd) for _ in range(FORMS))):
            nodes = parse(form)
            xs.append(features(nodes))
            ys.append(labels(nodes))
            ws.append([0.2 + math.log1p(x.chars) for x in nodes])
    y = np.concatenate(ys).astype(float)
    return boost(np.concatenate(xs), y, np.concatenate(ws))


def fit(pages: DataFrame, sample: int = SAMPLE):
    total = pages.count()
    if not total:
        return None
    share = min(1.0, sample / total)
    edge = int((share - 0.5) * float(1 << 64)) if share < 1 else (1 << 63) - 1
    rows = pages.filter(F.col("html").isNotNull() & (F.xxhash64(F.lit("page"), "page_id") <= edge)).select("page_id", "html").collect()
    return learn([(r.page_id, r.html) for r in rows])


def extract(pages: DataFrame, model, column: str = "html", out: str = "text") -> DataFrame:
    from pyspark.sql.pandas.functions import arrow_udf
    spark = pages.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @arrow_udf("string")
    def texts(values):
        import pyarrow as pa
        found = []
        for a in range(0, len(values), 100):
            found += main_texts(values.slice(a, 100).to_pylist(), shared.value)
        return pa.array(found, pa.string())
    return pages.withColumn(out, texts(F.col(column)))


def op6(pages: DataFrame) -> DataFrame:
    found = extract(pages.select("page_id", "url", "html"), fit(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
