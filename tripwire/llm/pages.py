"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks, the text between two block-level tags; inline tags and <br> don't end a block. A
block's features are its ancestors' tags, their class and id words, and traits of its text. The field has two labels
and a weight for each pair of neighbouring ones; it is trained by gradient ascent on labelled pages and decoded by
Viterbi. Labelled pages are the seeds below and a sample of about ``SAMPLE`` pages of the table that carry a landmark
(<article> or <main>), each also in a copy whose landmark features are left out, so that pages without one
are read by their other features.

Edge cases: null or empty html gives an empty text; unclosed and stray tags, comments and attributes end where a lenient
parser would end them (an unclosed script or style takes the rest of the page, other elements without content don't; a
quote that never closes doesn't open; elements deeper than ``DEPTH`` are read as neighbours); parsing is linear in the page; repeated rows each return a row; null ids and urls stay; an empty table gives an empty result;
other columns are ignored; pages are read whole.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripwire.llm.batches import release

#: Pages of the table that are used for training, about so many, and how long their html may be.
SAMPLE, SAMPLE_CHARS = 300, 200_000

#: Elements of HTML that end a block of text, that hold no content, and that are read as plain text.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object canvas audio video".split())
UNPARSED, FOREIGN = frozenset(("script", "style")), frozenset(("svg", "math"))
PLAIN = frozenset(("title", "textarea"))
#: An open element of the key is closed by a start tag of these.
CLOSED_BY = {
    "p": BLOCKS - {"button", "label", "legend", "caption", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot"},
    "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "option": frozenset(("option", "optgroup")),
    "tr": frozenset(("tr", "tbody", "tfoot")), "td": frozenset(("td", "th", "tr", "tbody", "tfoot")), "th": frozenset(("td", "th", "tr", "tbody", "tfoot")), "head": frozenset(("body",)),
}

#: How deep elements nest; browsers stop there as well.
DEPTH = 512
_DECLARED = r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*+(?:>|\Z)"
_TAG = r"<(/?)([a-zA-Z][^\s/>]*+)"
_PLAIN_TAG = re.compile(rf"{_DECLARED}|{_TAG}([^>]*+)(?:>|\Z)", re.S)
_TOKEN = re.compile(rf"{_DECLARED}|{_TAG}((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|(?P<unclosed><(?=/?[a-zA-Z]))", re.S)
_UNQUOTED = re.compile(r"=\s*[^\s\"'>]*/\s*$")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    tags: tuple[str, ...]
    names: tuple[str, ...]
    linked: int


def _closes_itself(attributes: str) -> bool:
    return attributes.rstrip().endswith("/") and not _UNQUOTED.search(attributes)


def _ends(page: str, tag: str) -> dict[int, int]:
    """Where the elements of a tag without content end, by where they begin; those that never end are left out."""
    out: dict[int, int] = {}
    opened: list[int] = []
    for m in re.finditer(rf"<(/?){re.escape(tag)}(?=[\s/>])([^>]*)>?", page, re.I):
        if not m[1]:
            if not (tag in FOREIGN and _closes_itself(m[2])):
                opened.append(m.start())
        elif tag in UNPARSED:
            out |= dict.fromkeys(opened, m.end())
            opened.clear()
        elif opened:
            out[opened.pop()] = m.end()
    return out


def leaf_blocks(page: str) -> list[Block]:
    """The leaf blocks that have text, in page order."""
    token, ends = _TOKEN, {}
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked, at = 0, 0

    def end() -> None:
        nonlocal linked
        if parts and (text := " ".join(html.unescape("".join(parts)).split())):
            out.append(Block(text, tuple(t for t, _ in stack), tuple(n for _, names in stack for n in names), linked))
        parts.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if any(t == "a" for t, _ in stack):
                linked += len(text)

    while m := token.search(page, at):
        if token is _TOKEN and m["unclosed"]:  # a quote that never closes: from here on, tags end at the next >
            token = _PLAIN_TAG
            m = token.match(page, m.start())
        say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if any(t in BLOCKS for t, _ in stack[k:]):
                        end()
                    del stack[k:]
                    break
                if stack[k][0] in ("td", "th", "table") and tag not in BLOCKS:
                    break
            else:
                if tag in BLOCKS:
                    end()
            continue
        if tag in RAW:
            if not (tag in FOREIGN and _closes_itself(m[3])):
                if tag not in ends:
                    ends[tag] = _ends(page, tag)
                at = ends[tag].get(m.start(), len(page) if tag in UNPARSED else at)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCKS:
            end()
            for k in range(len(stack) - 1, -1, -1):
                own = stack[k][0]
                if tag in CLOSED_BY.get(own, ()):
                    del stack[k:]
                elif own in BLOCKS and own != "p":
                    break
        if tag in VOID:
            continue
        names = tuple(w for x in _NAMES.findall(m[3]) for w in _WORD.findall("".join(x).lower())) if m[3] else ()
        if len(stack) >= DEPTH:
            stack.pop()
        stack.append((tag, names))
        if tag in PLAIN:
            close = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            say(page[at : close.start() if close else len(page)])
            end()
            stack.pop()
            at = close.end() if close else len(page)
    say(page[at:])
    end()
    return out


_LANDMARKS = ("article", "main")


def features(blocks: list[Block], landmarks: bool = True) -> list[list[str]]:
    """Names of the features that each block has."""
    out = []
    for k, b in enumerate(blocks):
        words, chars = b.text.count(" ") + 1, max(len(b.text), 1)
        seen = {f"in {t}" for t in b.tags if t in BLOCKS and (landmarks or t not in _LANDMARKS)}
        seen |= {f"named {n}" for n in b.names}
        seen |= {"bias", f"words {min(words.bit_length(), 8)}", f"linked {min(int(4 * b.linked / chars), 4)}", f"marks {min(sum(b.text.count(c) for c in '.,;:!?'), 4)}"}
        if block := next((t for t in reversed(b.tags) if t in BLOCKS), None):
            if landmarks or block not in _LANDMARKS:
                seen.add(f"is {block}")
        if k == 0:
            seen.add("first")
        if k == len(blocks) - 1:
            seen.add("last")
        if b.text[0] in "©|»«":
            seen.add("starts with a sign")
        out.append(sorted(seen))
    return out


_NOT_MAIN = frozenset(("nav", "header", "footer", "aside", "form", "button", "select", "title", "head", "dialog", "menu"))
_NOT_MAIN_NAMES = frozenset("ad ads advert advertisement banner breadcrumb comment comments cookie disqus footer menu nav navigation newsletter notice pagination popup promo related share sidebar social sponsor sponsored subscribe widget".split())


def landmark_labels(blocks: list[Block]) -> list[int]:
    """What a page with a landmark says of its blocks itself."""
    return [int(any(t in _LANDMARKS for t in b.tags) and not _NOT_MAIN.intersection(b.tags) and not _NOT_MAIN_NAMES.intersection(b.names)) for b in blocks]


#: Labelled seed pages: layouts without landmarks; an element whose class has the word "yes" is main text.
_P = "The committee met again in spring, and its report, which runs to forty pages, names three causes."
SEEDS = [
    f'<body><div class="header"><div class="logo">Daily</div></div><div id="menu"><a href=x>Home</a></div><div class="content"><h1 class=yes>A long title</h1><p class=yes>{_P}</p><p class=yes>Short one.</p><p class=yes>{_P} {_P}</p></div><div class="sidebar"><p>Most read</p><a href=x>One story</a></div><div class="comments"><p>I think this is wrong, and I said so before.</p></div><div class="footer">© 2020 Daily</div></body>',
    f'<body><div class="cookie notice">We use cookies to serve you.</div><header><ul><li><a href=x>News</a></li><li><a href=x>Sport</a></li></ul></header><div class="post entry"><h2 class=yes>Title here</h2><p class=yes>{_P}</p><blockquote class=yes>{_P}</blockquote><ul><li class=yes>{_P}</li><li class=yes>Second item, shorter.</li></ul></div><form><label>Name</label><button>Send</button></form><div class="comment">Great article! Thanks, everyone.</div><footer>© All rights reserved.</footer></body>',
    f'<body><nav><ul><li><a href=x>Start</a></li><li><a href=x>About</a></li></ul></nav><article><header>By the desk</header><h1 class=yes>Report</h1><p class=yes>{_P}</p><aside><p>Read more of this here, and there.</p></aside><p class=yes>{_P}</p><div class="ad">Buy now. Best prices, every day.</div><p class=yes>Fin.</p><section class="comments"><p>{_P}</p></section></article><aside><div class="widget">Newsletter: sign up, it is free.</div></aside><footer>© 2021 · Imprint</footer></body>',
    f'<body><div class="ad banner">Sale! Only today, only here.</div><div class="text"><p class=yes>{_P}</p><p class=yes>{_P}</p></div><div class="related"><a href=x>Other stories you may like</a></div><div class="share social"><a href=x>Share</a></div></body>',
    f'<body><table><tr><td class="nav"><a href=x>One</a></td><td class="body"><p class=yes>{_P}</p><p class=yes>{_P} {_P}</p><pre class=yes>some code here</pre></td></tr></table><form><p>Search the site</p></form><div class="footer"><p>© Contact, imprint, privacy.</p></div></body>',
    f'<body><main><h1 class=yes>Head</h1><div class="notice">This page has moved.</div><p class=yes>{_P}</p><form><p>Subscribe to our letter.</p></form><h2 class=yes>Part two</h2><p class=yes>{_P}</p></main><div class="comments"><div class="comment"><p>First!</p></div><div class="comment"><p>{_P}</p></div></div></body>',
    f'<body><header><h1>The Gazette</h1><p>News of the valley</p></header><div class="main"><h2 class=yes>Three causes</h2><p class=yes>{_P}</p><ul><li class=yes>{_P}</li><li class=yes>The second, which is short.</li></ul><p class=yes>{_P}</p><ol><li class=yes>First step, then wait.</li><li class=yes>{_P}</li></ol></div><footer><p>Legal. Contact. Terms of use.</p><p>All prices with tax.</p></footer></body>',
    f'<body><header><h1>A Blog</h1></header><ul class="navigation"><li><a href=x>Home</a></li><li><a href=x>Archive of posts</a></li></ul><div><h1 class=yes>Spring, at last</h1><p class=yes>{_P} {_P}</p><ul><li class=yes>Bread, cheese and a map.</li><li class=yes>{_P}</li></ul></div><footer><p>Written by hand. Imprint.</p></footer></body>',
]


def seed_labels(blocks: list[Block]) -> list[int]:
    return [int("yes" in b.names) for b in blocks]


@dataclass
class ChainField:
    """Weights of a two-label linear chain: by feature and label, for neighbours, and for the first block."""

    number: dict[str, int]
    weights: np.ndarray
    between: np.ndarray
    start: np.ndarray

    @classmethod
    def fit(cls, pages: list[tuple[list[list[str]], list[int]]], rounds: int = 150, rate: float = 0.3, decay: float = 1e-3) -> ChainField:
        """Maximum likelihood with an L2 penalty, by Adam on all pages at once."""
        pages = [p for p in pages if p[0]]
        number: dict[str, int] = {}
        for feats, _ in pages:
            for f in feats:
                for x in f:
                    number.setdefault(x, len(number))
        longest = max(len(y) for _, y in pages)
        order = np.array([(p, t, number[x]) for p, (feats, _) in enumerate(pages) for t, f in enumerate(feats) for x in f])
        gold, there = np.zeros((len(pages), longest), int), np.zeros((len(pages), longest), bool)
        for p, (_, y) in enumerate(pages):
            gold[p, : len(y)], there[p, : len(y)] = y, True
        flat = order[:, 0] * longest + order[:, 1]
        hot = np.eye(2)[gold] * there[:, :, None]
        theta = [np.zeros((len(number), 2)), np.zeros((2, 2)), np.zeros(2)]
        moment = [[np.zeros_like(x), np.zeros_like(x)] for x in theta]
        both = there[:, 1:, None, None] * 1.0
        for step in range(1, rounds + 1):
            score = np.zeros((len(pages) * longest, 2))
            np.add.at(score, flat, theta[0][order[:, 2]])
            node, pair = cls._marginals(score.reshape(len(pages), longest, 2), theta[1], theta[2], there)
            off = (hot - node).reshape(-1, 2)
            grads = [np.zeros_like(theta[0]), (hot[:, :-1, :, None] * hot[:, 1:, None, :] - pair * both).sum((0, 1)), (hot[:, 0] - node[:, 0]).sum(0)]
            np.add.at(grads[0], order[:, 2], off[flat])
            for x, g, (m, v) in zip(theta, grads, moment, strict=True):
                g = g / len(pages) - decay * x
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return cls(number, *theta)

    @staticmethod
    def _marginals(score: np.ndarray, between: np.ndarray, start: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward over padded pages: probabilities of labels, and of neighbouring pairs."""
        n, t, _ = score.shape
        score = np.where(there[:, :, None], score, 0)
        links = np.where(there[:, 1:, None, None], between, 0)
        ahead, back = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0] + start
        for k in range(1, t):
            ahead[:, k] = score[:, k] + np.logaddexp.reduce(ahead[:, k - 1, :, None] + links[:, k - 1], axis=1)
        for k in range(t - 2, -1, -1):
            back[:, k] = np.logaddexp.reduce(links[:, k] + (score[:, k + 1] + back[:, k + 1])[:, None, :], axis=2)
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        node = np.exp(ahead + back - total[:, None, None]) * there[:, :, None]
        pair = np.exp(ahead[:, :-1, :, None] + links + (score[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, None, None, None])
        return node, pair

    def decode(self, feats: list[list[str]]) -> list[int]:
        """The most likely labels, by Viterbi."""
        if not feats:
            return []
        a, b = (x.tolist() for x in (self.between, self.weights))
        number, best, back = self.number, self.start.tolist(), []
        for k, f in enumerate(feats):
            own = [0.0, 0.0]
            for x in f:
                if (i := number.get(x)) is not None:
                    own[0] += b[i][0]
                    own[1] += b[i][1]
            if k:
                via = [int(best[1] + a[1][y] > best[0] + a[0][y]) for y in (0, 1)]
                back.append(via)
                best = [best[via[y]] + a[via[y]][y] + own[y] for y in (0, 1)]
            else:
                best = [best[y] + own[y] for y in (0, 1)]
        label = int(best[1] > best[0])
        out = [label]
        for via in reversed(back):
            label = via[label]
            out.append(label)
        return out[::-1]


def train(pages: DataFrame, sample: int = SAMPLE) -> ChainField:
    """A field trained on the seeds and on about ``sample`` pages with a landmark, twice as many at most."""
    labelled = pages.select("page_id", "html").filter(F.col("html").isNotNull() & (F.length("html") <= SAMPLE_CHARS) & F.lower("html").rlike("<(article|main)[\\s>]"))
    total, parts = labelled.count(), 1 << 30
    # by page, so that copies of one page don't come all at once or not at all; the limit is for tables of one page again and again
    share = int(min(1.0, sample / max(total, 1)) * parts)
    picked = labelled.filter(F.pmod(F.xxhash64(F.lit(14), "page_id", "html"), F.lit(parts)) < share).select("html").limit(2 * sample)
    training = []
    for page, label in [*((x, seed_labels) for x in SEEDS for _ in range(5)), *((r["html"], landmark_labels) for r in picked.collect())]:
        blocks = leaf_blocks(page)
        gold = label(blocks)
        for b in blocks:
            b.names = tuple(n for n in b.names if n != "yes")
        training += [(features(blocks, landmarks), gold) for landmarks in (True, False)]
    return ChainField.fit(training)


EXTRACTED = "page_id long, url string, text string, n_chars long, n_blocks long"


def extract(pages: DataFrame, field: ChainField | None = None) -> DataFrame:
    """Per page: page_id, url, text (its main blocks, one a line), n_chars, n_blocks."""
    shared = pages.sparkSession.sparkContext.broadcast(field or train(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        own.weights = np.asarray(own.weights)
        for batch in release(batches):
            texts, counts = [], []
            for page in batch.column("html"):
                blocks = leaf_blocks(page.as_py() or "")
                labels = own.decode(features(blocks))
                texts.append("\n".join(b.text for b, y in zip(blocks, labels, strict=True) if y))
                counts.append(sum(labels))
            columns = [pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *columns], names=["page_id", "url", "text", "n_chars", "n_blocks"])

    return pages.select("page_id", "url", "html").mapInArrow(run, EXTRACTED)
