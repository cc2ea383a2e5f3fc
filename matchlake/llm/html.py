"""Operator 3: the main text of web pages from flat text blocks.

A page becomes a list of blocks, the text between block-level tags. Each has shallow features: its words and link
density, those of the blocks before and after it, what kind of element it is, what the elements around it
say they are, and whether the block before was text. A decision tree, trained on the labelled blocks
of the small pages below, goes through the blocks in order and tells text from the rest; text blocks are joined in page
order.

Markup is read as browsers do where it is not well formed: the head ends with the first tag or text that is none of it, a
block ends an open paragraph, button or list entry of its kind and inline tags that were left open, and an end tag without
a start is passed over. `<br>` is white space. A form around structural tags is no form. Names of classes and ids count as
whole tokens, by their last part, and never on html and body.

Edge cases: null and empty pages have the empty text; a page without tags is one block, its text; markup that is cut off is
read as far as it goes; unknown character references stay as they are; repeated rows are extracted each; null ids and
urls are kept; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import tidy

# Fixed values of HTML: tags that begin and end a block, tags whose content is never text, tags without content.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead tr ul".split())
SILENT_TAGS = frozenset("head title script style noscript template svg math iframe object canvas audio video select option button textarea datalist".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD_TAGS = frozenset("base basefont link meta noscript script style template title".split())
#: Of the silent ones, those that end where a block begins.
SHORT_TAGS = frozenset("button option select datalist svg math".split())
#: A block tag of the key closes open ones of the value.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th")}
STRUCTURE = frozenset("article main nav header footer section h1 table".split())
# Names that say what an element is for.
APART_TAGS = frozenset("nav footer aside form menu dialog".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
APART_NAMES = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal newsletter subscribe signup login menu nav navbar navigation breadcrumb breadcrumbs sidebar widget header masthead footer copyright legal comment comments commentlist replies disqus discussion respond related recommended recommendations share sharing social toolbar pagination pager search form".split())
MAIN_NAMES = frozenset("article main content story post entry body text".split())
AD_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored".split())
COMMENT_NAMES = frozenset("comment comments commentlist replies respond disqus discussion".split())
#: Parts before a name that say that the element is not that, but has or lacks it.
ABOUT = frozenset("has have with no without hide show is not".split())
#: A heading of such words alone begins what readers or the site add.
ADDED_HEADINGS = frozenset("comment comments reply replies response responses discussion leave a your write post all of the to this on reader readers join related similar more recommended read next also you may might like articles article stories posts news latest popular most share follow us kommentar kommentare commentaire commentaires comentario comentarios antworten".split())
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "tags", "names", "comments", "heading", "entry", "paragraph", "added", "share", "sentences", "text_before")

# Labelled pages in short. "+8-20" stands for 8 to 20 words of text, "-8-20" for as many that are not text.
_MENU = "<ul><li><a href=x>-1-2</a><li><a href=x>-1-2</a><li><a href=x>-1-3</a></ul>"
_TOP = f"<div class=logo>-1-3</div><nav>{_MENU}</nav>"
_END = "<footer><p>-4-20</p><a href=x>-1-2</a></footer>"
PAGES = (
    f"{_TOP}<article><h1>+2-14</h1><p>+20-120</p><p>+3-60</p><p>+1-12</p></article>{_END}",
    f"{_TOP}<div>-2-15</div><article><h1>+1-9</h1><p>+1-9</p><p>+1-40</p><p>+1-9</p></article>{_END}",
    f"{_TOP}<article><p>+1-9</p><h2>+1-9</h2><p>+1-9</p><div>+1-9</div><ul><li>+1-9<li><a href=x>+1-9</a></ul></article><div>-2-30</div>",
    f"{_TOP}<div>-2-15</div><main><h1>+1-9</h1><div>+1-9</div><div>+1-40</div><h2>+1-9</h2><ol><li>+1-9<li>+1-30</ol></main>{_END}",
    f"{_TOP}<div class=ad>-3-15</div><article><h1>+2-12</h1><p>+1-14</p></article>{_END}",
    f"{_TOP}<article><header><h1>+2-12</h1><p>+3-9</p></header><p>+20-90</p><ul><li>+3-12<li>+2-9<li><a href=x>+1-5</a></ul><p>+8-50</p></article>{_END}",
    f"{_TOP}<main><h1>+3-12</h1><p>+20-80 <a href=x>+1-4</a> +3-20</p><h2>+1-6</h2><p>+15-70</p><blockquote>+10-40</blockquote><p>+2-20</p></main><aside><h3>-1-4</h3>{_MENU}</aside>{_END}",
    f"{_TOP}<main><article><h1>+3-10</h1><p>+30-90</p><aside><p>-8-30</p></aside><p>+10-60</p></article><section class=comments><h2>-1-3</h2><p>-5-60</p><p>-8-40</p></section></main>{_END}",
    f"{_TOP}<main><article><h1>+3-10</h1><p>+30-90</p><p>+10-60</p><footer><a href=x>-1-3</a> -2-6</footer></article><h3>Comments</h3><div>-1-3</div><p>-5-60</p><div>-1-3</div><p>-8-40</p></main>{_END}",
    f"{_TOP}<article><h1>+3-10</h1><p>+30-90</p><p>+10-60</p></article><div id=respond><h3>Leave a reply</h3><p>-5-20</p></div><ol class=commentlist><li>-5-60<li>-4-80</ol>{_END}",
    f"<div>{_MENU}</div><h1>+2-12</h1><p>+20-90</p><p>+15-80</p><p>+2-16</p><div>-2-8</div>",
    f"<div>{_MENU}</div><div><h1>+2-12</h1><div>+20-90</div><div>+15-80</div><div>+8-16</div></div><div><a href=x>-1-3</a> <a href=x>-1-3</a></div>",
    f"<div><a href=x>-1-2</a> <a href=x>-1-2</a></div><h1>+3-9</h1><p>+20-90</p><h2>+2-8</h2><p>+15-80</p><ul><li>+4-20<li>+4-20</ul><p>+2-16</p><ul><li><a href=x>-1-3</a><li><a href=x>-1-3</a></ul>",
    f"<div class=menu>{_MENU}</div><div class=content><h1>+3-9</h1><p>+20-90</p><p>+1-9</p><ul><li>+3-9<li><a href=x>+2-6</a><li><a href=x>+2-6</a></ul><p>+4-50</p></div><div class=sidebar><h3>-1-3</h3><p>-5-40</p></div><div class=footer>-4-30</div>",
    f"<div id=nav>{_MENU}</div><div id=cookie-notice>-10-40</div><div class=post><div class=entry-header><h1>+3-9</h1></div><div class=entry-content><p>+20-90</p><p>+9-60</p><p>+1-9</p></div></div><div class=related><h3>Related articles</h3><a href=x>-5-12</a></div>",
    f"{_TOP}<div class=cookie-banner><p>-12-50</p><button>-1-2</button></div><article><h1>+3-9</h1><p>+20-90</p><div class=share><a href=x>-1</a></div><p>+9-60</p></article><div class=newsletter><p>-6-30</p><form><label>-1-4</label></form></div>{_END}",
    f"{_TOP}<div><h1>+3-9</h1><p>-1-4</p><p>+25-90</p><p>+25-90</p><form><label>-3-20</label><p>-4-12</p></form><p>+12-70</p></div>{_END}",
    f"{_TOP}<article><h1><a href=x>+1-9</a></h1><p>+1-9 <a href=x>+1-6</a> +1-9</p><p><a href=x>+1-9</a></p><p>+1-60 <a href=x>+1-9</a></p></article>{_END}",
    f"{_TOP}<div>-5-40</div><main><h1>+1-9</h1><p>+1-9 <a href=x>+1-9</a></p><ul><li><a href=x>+1-9</a> +1-9<li><a href=x>+1-9</a></ul><p>+1-90</p><p>+1-9</p></main><div>-2-30</div>",
    "+1-9", "<div>+1-9</div>", "<p>+1-6</p>", "<h1>+1-5</h1><div>+1-12</div>",
    "+1-60", "<p>+1-40</p>", "<body>+3-80</body>", "<div>+1-40</div>", "<h1>+1-8</h1><p>+5-90</p>", "<h1>+1-8</h1><p>+1-6</p>", "<p>+20-90</p><p>+1-16</p>",
    "<article><p>+1-9</p></article>", "<main><p>+1-9</p><p>+1-9</p></main>", "<article><ul><li><a href=x>+1-5</a><li><a href=x>+1-5</a></ul></article>",
    f"<header><h1>-1-4</h1><p>-2-9</p></header><nav>{_MENU}</nav><section><h1>+2-9</h1><p>+20-80</p><p>+3-40</p></section><aside>-8-60</aside>{_END}",
    f"<header>{_MENU}</header><section><h2>+2-9</h2><p>+20-80</p><h2>+2-9</h2><p>+3-40</p></section><section class=comments><h2>Comments</h2><article><p>-5-70</p></article><article><p>-5-70</p></article></section>{_END}",
    f"<table><tr><td>{_MENU}</td><td><h2>+2-8</h2><p>+25-90</p><p>+18-70</p></td></tr><tr><td>-3-9 <a href=x>-1-3</a></td></tr></table>",
    f"{_TOP}<article><h1>+3-9</h1><p>+12-60</p><table><tr><td>+1-3<td>+1-4<tr><td>+1-3<td>+1-4</table><figure><figcaption>+3-14</figcaption></figure><pre>+5-40</pre><dl><dt>+1-3<dd>+4-20</dl></article>{_END}",
    f"{_TOP}<h1>+3-9</h1><div>+12-60</div><div>+8-50</div><h3>Related</h3><ul><li><a href=x>-3-9</a><li><a href=x>-3-9</a></ul><h3>More news</h3><p>-8-20</p>{_END}",
    f"<div class=top>-2-6</div><ul><li><a href=x>-1-2</a></ul><div class=widget><h4>-1-3</h4><p>-9-50</p></div><div class=story><p>+18-80</p><p>+2-50</p></div><div class=copyright>-5-25</div>",
    f"<div>-1-3</div><div><a href=x>-1-3</a></div><h1>+3-9</h1><div>-1-5</div><p>+22-90</p><p>+22-90</p><p>+4-16</p><div>-2-6 <a href=x>-1-3</a></div><div>-3-10</div>",
    f"{_TOP}<main><p>+1-6</p><h2>+1-6</h2><ul><li><a href=x>+1-6</a><li>+1-6</ul></main><div class=ads><p>-5-60</p></div>{_END}",
    # short lines among long ones
    f"{_TOP}<div class=ad>-3-15</div><article><h1>+2-14</h1><p>+10-90</p><p>+1-3</p><p>+20-90</p><p>+1-2</p></article>{_END}",
    f"{_TOP}<div class=ad>-3-15</div><article><h1>+2-14</h1><p>+1-3</p><p>+1-3</p><div>+1-30</div></article>{_END}",
    f"{_TOP}<div class=ad>-3-15</div><main><h1>+2-14</h1><p>+1-90</p><p>+1-3</p><p>+1-60</p></main><div class=ad>-3-15</div>{_END}",
    f"{_TOP}<div class=ad>-3-15</div><h1>+2-14</h1><p>+10-90</p><p>+1-3</p><p>+20-90</p><div class=ad>-3-15</div>{_END}",
    f"{_TOP}<div class=ad>-3-15</div><div><h1>+2-14</h1><div>+10-90</div><div>+20-90</div></div><div class=sponsor>-3-30</div>{_END}",
    f"{_TOP}<div class=promo>-3-25</div><div class=content><h1>+2-14</h1><p>+10-90</p><p>+1-3</p><p>+20-90</p></div><div class=legal>-3-40</div>{_END}",
    f"{_TOP}<article><h1>+2-14</h1><p>+10-90</p><p>+1-3</p><div class=ad>-3-25</div><p>+1-3</p><p>+20-90</p><p>+1-3</p></article><div class=ad>-3-25</div>{_END}",
    "<div class=nav><a href=x>-1-2</a></div><h1>+1-12</h1><p>+15-90</p><p>+1-20</p>", f"<div class=menu>{_MENU}</div><h1>+1-3</h1><p>+15-90</p><p>+1-20</p><div class=footer>-4-30</div>",
    # few tags, much text
    "<nav><a href=x>-1-2</a></nav><div>+20-300</div><div>+20-300</div>",
    "<nav><a href=x>-1-2</a> <a href=x>-1-2</a></nav><div>+20-300</div><div>+4-60</div><div>+20-200</div>",
    "<table><tr><td><a href=x>-1</a></td><td>+30-300<br>+30-300</td></tr></table>",
    "<table><tr><td><a href=x>-1-2</a><br><a href=x>-1-2</a></td><td><h1>+2-9</h1>+30-300<br>+30-300</td></tr><tr><td>-3-9 <a href=x>-1-3</a></td></tr></table>",
    "<div><nav><a href=x>-1-2</a></nav>+20-300<br><br>+20-300</div>", f"<div><nav>{_MENU}</nav><h1>+2-9</h1>+20-300<br><br>+20-300</div>",
    f"{_TOP}<div>+40-300</div>", f"{_MENU}<div>+40-300</div><div>+40-300</div><div>-2-9 <a href=x>-1-3</a></div>",
    # names that do not say what is there
    f"{_TOP}<div class=search><h1>+2-9</h1><p>+20-120</p><p>+8-90</p><p>+1-14</p></div>{_END}",
    f"{_TOP}<main><h1>+2-9</h1><section class=legal><p>+20-120</p><p>+8-90</p><p>+1-14</p></section></main>{_END}",
    f"{_TOP}<div class=widget><h1>+2-9</h1><p>+20-120</p><h2>+1-6</h2><p>+8-90</p><ul><li>+2-12<li>+2-12</ul></div>{_END}",
    f"<div class=menu>{_MENU}</div><div class=form><h1>+2-9</h1><p>+20-120</p><p>+2-30</p><p>+20-120</p></div><div class=footer>-4-30</div>",
    f"{_TOP}<div class=social><h2>+2-9</h2><p>+30-120</p><p>+30-120</p></div><div class=sidebar><h3>-1-3</h3><p>-5-40</p></div>{_END}",
    f"{_TOP}<div class=banner><p>+30-120</p><p>+30-120</p><p>+1-20</p></div><div class=promo><p>-5-40</p></div>{_END}",
    f"{_TOP}<div class=header><h1>+2-12</h1></div><p>+30-120</p><p>+10-90</p><div class=share><a href=x>-1</a> <a href=x>-1</a></div>{_END}",
    f"{_TOP}<main><div class=header><h1>+2-12</h1></div><p>+30-120</p><p>+10-90</p></main>{_END}",
    # short lines in what stands apart
    f"{_TOP}<article><h1>+2-12</h1><p>+3-60</p><p>+1-9</p></article><div class=sidebar><p>-1-4</p></div>{_END}",
    f"{_TOP}<article><h1>+2-12</h1><p>+3-60</p><p>+1-9</p></article><div class=sidebar><p>-1-4.</p></div>{_END}",
    f"{_TOP}<article><h1>+2-12</h1><p>+3-90</p><p>+1-9</p></article><div class=sidebar><h3>-1-4</h3><p>-1-9</p><h3>-5-30</h3><p>-1-5.</p></div>{_END}",
    f"{_TOP}<div class=promo><p>-1-6</p></div><main><h1>+2-12</h1><p>+3-90</p><div class=related><h3>-1-30</h3><ul><li>-1-6<li>-1-6.</ul></div><p>+3-60</p></main><div class=notice>-1-6</div>{_END}",
    f"{_TOP}<div class=notice><p>-1-4.</p></div><main><h1>+2-12</h1><p>+3-90</p><p>+1-9</p><div class=related><p>-1-6.</p></div><p>+3-60</p></main>{_END}",
    f"<div class=menu>{_MENU}</div><h1>+2-12</h1><p>+10-90</p><div class=widget>-1-4</div><p>+3-60</p><div class=widget><ul><li>-1-30<li>-1-30</ul></div>{_END}",
    "<h1>+2-12</h1><p>+10-90</p><p>+10-60</p><div class=social>-1-4</div>", "<h1>+2-12</h1><p>+10-90</p><p>+10-60</p><div class=promo><p>-1-5.</p></div>",
    "<h1>+2-12</h1><p>+10-90</p><p>+10-60</p><div class=widget><h3>-1-30</h3></div>", "<h1>+2-12</h1><p>+10-90</p><p>+10-60</p><div class=promo><ul><li>-1-30<li>-1-30</ul></div>",
    "<h1>+2-12</h1><p>+10-90</p><p>+10-60</p><div class=related><p>-1-4</p></div>", "<h1>+2-12</h1><p>+10-90</p><p>+1-9</p><div class=related><ul><li>-1-4<li>-1-4</ul></div>",
    "<article><h1>+2-12</h1><p>+10-90</p><p>+1-9</p></article><div class=share><p>-1-4</p></div>", "<article><h1>+2-12</h1><p>+10-90</p><p>+1-9</p></article><div class=share>-1-4</div>",
    "<h1>+1-12</h1><p>+15-90</p><p>+15-90</p><h3>Comments</h3><p>-5-60</p><p>-5-60</p>",
    # several articles
    f"{_TOP}<main><article><h2>+2-12</h2><p>+12-120</p><p>+3-60</p></article><article><h2>+2-12</h2><p>+12-120</p><p>+3-60</p></article></main>{_END}",
    f"{_TOP}<article><h2>+2-12</h2><p>+12-120</p></article><article><h2>+2-12</h2><p>+12-120</p><p>+3-60</p></article><aside><p>-5-40</p></aside>{_END}",
    # adverts and readers without a name
    f"{_TOP}<article><h1>+3-10</h1><p>+30-90</p><div><a href=x>-4-20</a></div><p>+10-60</p><div class=ad><p>-5-30</p></div><p>+10-60</p></article>{_END}",
    f"{_TOP}<article><h1>+3-10</h1><p>+30-90</p><p>+10-60</p></article><div><h3>Comments</h3><div>-1-3</div><p>-5-60</p><div>-1-3</div><p>-8-40</p></div>{_END}",
    f"{_TOP}<main><article><h1>+3-10</h1><p>+30-90</p><p>+10-60</p></article><div><div>-1-3</div><div>-5-60</div></div><div><div>-1-3</div><div>-8-40</div></div></main>{_END}",
)
DRAWS = 24
_SENTENCE = re.compile(r"[.!?…。][\"'”’)]*(?=\s|$)")
_IN_HEADING = re.compile("<h[1-6][^<]*(<a [^<]*)?$")
_SLOT = re.compile(r"([+-])(\d+)(?:-(\d+))?")


def train_tree(rows: np.ndarray, depth: int = 12, least: int = 3):
    """A tree of (feature, threshold, at most, above) and leaves 0 or 1, split where Gini impurity falls most. The last
    column of `rows` is the label."""
    x, y = rows[:, :-1], rows[:, -1]
    if depth == 0 or y.min() == y.max() or len(y) < 2 * least:
        return int(2 * y.sum() >= len(y))
    best = (len(y) * y.mean() * (1 - y.mean()) - 1e-9, None, None)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, good = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y))
        low, high = good[:-1] / n, (good[-1] - good[:-1]) / (len(y) - n)
        loss = n * low * (1 - low) + (len(y) - n) * high * (1 - high)
        loss[(v[1:] == v[:-1]) | (n < least) | (len(y) - n < least)] = np.inf
        k = int(loss.argmin()) if len(loss) else 0
        if len(loss) and loss[k] < best[0]:
            best = (loss[k], f, float(v[k] + v[k + 1]) / 2)
    _, f, cut = best
    if f is None:
        return int(2 * y.sum() >= len(y))
    low = x[:, f] <= cut
    return (f, cut, train_tree(rows[low], depth - 1, least), train_tree(rows[~low], depth - 1, least))


def labelled_blocks(pages=PAGES, draws: int = DRAWS, seed: int = 3) -> np.ndarray:
    """Rows of FEATURES and a label, from `draws` drawings of each page."""
    rng, rows = np.random.Generator(np.random.PCG64(seed)), []

    def words(m) -> str:
        n = int(rng.integers(int(m[2]), int(m[3] or m[2]) + 1))
        out = ["text" if m[1] == "+" else "rest"] * n
        if (n > 5 or m[1] == "+") and not _IN_HEADING.search(m.string, 0, m.start()) and rng.random() < 0.7:  # a sentence or more
            ends = {n - 1, *np.cumsum(rng.integers(6, 25, n // 6 + 1)).tolist()}
            out = [w + "." if k in ends else w for k, w in enumerate(out)]
        return " ".join(out)

    for page in pages:
        for _ in range(draws):
            before = -1
            for text, row in blocks(_SLOT.sub(words, page)):
                label = int(text.startswith("text"))
                rows.append((*row, before, label))
                before = label
    return np.array(rows, dtype=float)


def classify(tree, row) -> int:
    while not isinstance(tree, int):
        f, cut, low, high = tree
        tree = low if row[f] <= cut else high
    return tree


def _part(token: str) -> str:
    """What a class or id says that its element is: the last part of the token, if the part before does not say otherwise."""
    parts = [x for x in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", token).lower()) if x]
    if not parts or (len(parts) > 1 and parts[-2] in ABOUT):
        return ""
    return "ad" if parts[0] in AD_NAMES else parts[-1]


class _Blocks(HTMLParser):
    """Collects (text, words, linked words, tags, names, comments, heading, entry, paragraph, added) of each block of a page.
    What holds for a place in the page is kept with the innermost open tag, so that no piece of text looks up the tree."""

    def __init__(self, articles: int):
        super().__init__(convert_charrefs=True)
        # (tag, silent, link, tags, names, comments, heading, entry, paragraph, region) of each open tag, inherited from the one around it
        self.stack = [("", False, False, 0, 0, 0, 0, 0, 0, 0)]
        self.open, self.articles, self.added = Counter(), articles, 0
        self.blocks, self.parts, self.linked = [], [], 0
        self.regions = 0  # elements of foreign names so far; each block has the outermost around it, 0 for none

    def flush(self):
        words = "".join(self.parts).split()
        if words:
            _, _, _, tags, names, comments, heading, entry, paragraph, region = self.stack[-1]
            if heading:
                said = re.findall(r"[^\W\d_]+", " ".join(words[:8]).lower())
                self.added = int(bool(said) and len(words) <= 8 and ADDED_HEADINGS.issuperset(said))
            self.blocks.append((" ".join(words), len(words), min(self.linked, len(words)), tags, names, comments, heading, entry, paragraph, self.added, region))
        self.parts, self.linked = [], 0

    def pop(self):
        self.open[self.stack.pop()[0]] -= 1

    def close_to(self, tag):
        while self.stack[-1][0] != tag:
            self.pop()
        self.pop()

    def push(self, tag, attrs):
        _, silent, link, tags, names, comments, heading, entry, paragraph, region = self.stack[-1]
        before = names
        if tag in BLOCK_TAGS:
            heading, entry, paragraph = (tag[0] == "h" and tag[1:].isdigit()) or heading, tag in ("li", "dt", "dd", "td", "th") or entry, tag in ("p", "blockquote", "pre", "figcaption")
            heading, entry, paragraph = int(heading), int(entry), int(paragraph)
        if tag == "a":
            link = link or any(k == "href" for k, _ in attrs)
        elif tag not in ("html", "body"):
            found = {_part(x) for k, v in attrs if k in ("class", "id") and v for x in v.split()}
            roles = {v.strip().lower() for k, v in attrs if k == "role" and v}
            if tag in APART_TAGS or roles & APART_ROLES or (tag == "header" and tags < 1):
                tags = -1
            elif (tag in ("article", "main") or roles & {"main", "article"}) and tags > -1:
                tags = 1
            if tag == "main" or (tag == "article" and self.articles == 1):
                names = 0  # a layout's name on what is around it all says nothing
            if found & COMMENT_NAMES:
                comments, names = 1, -1
            elif found & APART_NAMES and tag not in ("article", "main") and not ("header" in found and (tags > 0 or names > 0)):
                names = -1
            elif found & MAIN_NAMES and names > -1:
                names = 1
        if names > -1:
            region = 0
        elif before > -1:
            self.regions += 1
            region = self.regions
        self.stack.append((tag, silent or tag in SILENT_TAGS, link, tags, names, comments, heading, entry, paragraph, region))
        self.open[tag] += 1

    def end_head(self):
        if self.open["head"]:
            self.close_to("head")

    def handle_starttag(self, tag, attrs):
        if tag not in HEAD_TAGS and tag not in ("html", "head"):
            self.end_head()
        if tag in VOID_TAGS:
            if tag == "hr":
                self.flush()
            self.parts.append(" ")
            return
        if tag == "a" and self.open["a"]:
            while self.stack[-1][0] not in BLOCK_TAGS and self.stack[-1][0] != "a" and len(self.stack) > 1:
                self.pop()
            if self.stack[-1][0] == "a":
                self.pop()
        if tag in BLOCK_TAGS:
            self.flush()
            for short in SHORT_TAGS:
                if self.open[short]:
                    self.close_to(short)
            # A block ends inline tags that were left open, but not a link around blocks; and an open paragraph.
            while len(self.stack) > 1 and self.stack[-1][0] not in BLOCK_TAGS and self.stack[-1][0] not in SILENT_TAGS and self.stack[-1][0] != "a":
                self.pop()
            for shut in ("p", *CLOSES.get(tag, ())):
                if self.stack[-1][0] == shut or (self.open["a"] and len(self.stack) > 1 and self.stack[-1][0] == "a" and self.stack[-2][0] == shut):
                    self.close_to(shut)
            if tag in STRUCTURE and self.open["form"]:  # a form around the page; from now on it is no form
                inner = next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == "form")
                around = self.stack[inner - 1][3]
                self.stack[inner:] = [(*x[:3], around if x[3] == -1 else x[3], *x[4:]) if x[0] not in APART_TAGS or i == 0 else x for i, x in enumerate(self.stack[inner:])]
                self.stack[inner] = ("no form", *self.stack[inner][1:])
                self.open["form"] -= 1
                self.open["no form"] += 1
        self.push(tag, attrs)

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCK_TAGS:
            self.flush()
        self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag in BLOCK_TAGS:
            self.flush()
        if not self.open[tag]:
            return
        if tag not in BLOCK_TAGS and tag not in SILENT_TAGS and tag != "a":
            # An end tag of an inline element does not reach over a block.
            at = len(self.stack) - 1
            while self.stack[at][0] != tag and self.stack[at][0] not in BLOCK_TAGS:
                at -= 1
            if self.stack[at][0] != tag:
                return
        self.close_to(tag)

    def handle_data(self, data):
        if self.stack[-1][0] == "head" and not data.isspace():
            self.end_head()
        _, silent, link, *_ = self.stack[-1]
        if not silent:
            self.parts.append(data)
            if link:
                self.linked += len(data.split())


def whole_markup(page: str) -> str:
    """Without a comment, and without a tag, that never ends: nothing after its beginning is looked at again and again."""
    end = page.rfind("-->")
    begin = page.find("<!--", end + 3 if end >= 0 else 0)
    page = page if begin < 0 else page[:begin]
    end = page.rfind(">")
    cut = re.compile("<[a-zA-Z/!?]").search(page, end + 1)
    return page[: cut.start()] if cut else page


def blocks(page: str | None) -> list[tuple]:
    """Text blocks of a page, each with its features in the order of FEATURES, all but the last."""
    page = whole_markup(page or "")
    parser = _Blocks(len(re.findall(r"<article\b", page, re.I)))
    parser.feed(page)
    parser.close()
    parser.flush()
    found, out = parser.blocks, []
    shares = [0.0, *(b[2] / b[1] for b in found), 0.0]
    sizes = [0, *(b[1] for b in found), 0]
    held = Counter()
    for b in found:
        held[b[-1]] += b[1] - b[2]
    plain = max(1, sum(held.values()))
    for i, b in enumerate(found, 1):
        share = held[b[-1]] / plain if b[-1] else 0.0
        sentences = min(9, len(_SENTENCE.findall(b[0])))
        out.append((b[0], (b[1], shares[i], sizes[i - 1], shares[i - 1], sizes[i + 1], shares[i + 1], *b[3:-1], share, sentences)))
    return out


def text_blocks(page: str | None, tree) -> tuple[list[str], int]:
    """The blocks that are text, and the number of all."""
    found, good, before = blocks(page), [], -1
    for text, row in found:
        before = classify(tree, (*row, before))
        if before:
            good.append(text)
    return good, len(found)


def main_text(page: str | None, tree) -> str:
    return "\n".join(text_blocks(page, tree)[0])


def extract(pages: DataFrame, labelled: np.ndarray | None = None) -> DataFrame:
    """page_id, url, html -> page_id, url, text, n_chars, n_blocks, n_kept."""
    tree = train_tree(labelled_blocks() if labelled is None else labelled)

    @tidy
    def run(batches):
        for batch in batches:
            texts, made, kept = [], [], []
            for page in batch.column("html").to_pylist():
                good, n = text_blocks(page, tree)
                texts.append("\n".join(good))
                made.append(n)
                kept.append(len(good))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64()), pa.array(made, pa.int32()), pa.array(kept, pa.int32())], ["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks int, n_kept int")


def op3(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
