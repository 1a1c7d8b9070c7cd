"""Main text of pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into blocks (dom.blocks). Each has binary features: its own and its ancestors' tags, what their class, id and role words
tell, its length, link share and punctuation, and the same of its neighbours. The field has a weight for each feature and label, and one for
each pair of neighbouring labels; it is trained on labelled pages by maximum likelihood (forward-backward over a padded batch,
Adam steps, an L2 penalty) and decoded by Viterbi. A page whose best labelling is all outside, though some block stands outside every landmark that is never an article's (menus,
headers, footers, sidebars, notices, adverts, forms, comments, by tag or name), takes the best labelling with such a block inside. By default the labelled pages come from page_maker, with a
fixed seed and number; `train` takes any others.

A page is one row and is read to its end, so rows need no shuffle. Defined results: null, empty or textless pages, and pages that have marked blocks only and are told to hold no article, have an empty text; repeated rows have equal results; unknown
markup is text inside its parent; a page cut off inside a tag ends there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.dom import Block, Element, blocks
from graphloom.llm.page_maker import PageMaker

TRAIN_PAGES, SEED = 800, 404
#: What words of class, id and role stand for.
ROLES = {
    "ad": "ad ads advert adverts advertisement advertising adsbox adsense sponsored sponsor promo promotion banner outbrain taboola anzeige anzeigen werbung publicidad publicite pubblicita reklame",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs topnav toolbar pagination pager tabs toc skip menue navigazione navegacion navegador navi hauptmenu migas brotkrumen ariane",
    "comment": "comment comments reply replies respond response responses discussion disqus thread reader readers kommentar kommentare commentaire commentaires comentario comentarios commenti",
    "side": "sidebar side related widget recommended recommendations trending popular more teaser aside complementary bio recent rail seitenleiste barra lateral laterale marginalspalte",
    "notice": "cookie cookies consent notice gdpr alert popup modal newsletter subscribe subscription paywall warning message privacy dialog alertdialog overlay signup toast disclaimer hinweis aviso avis meldung banniere",
    "foot": "footer foot copyright legal bottom contentinfo colophon fuss fusszeile impressum pie pied rodape piede",
    "head": "header masthead topbar branding logo top kopf kopfzeile cabecera entete encabezado testata",
    "share": "share sharing social tags meta byline date",
    "form": "form login search contact",
    "main": "content article post entry main body story text page inhalt contenido contenu contenuto artikel articulo beitrag texto texte",
    "hidden": "hidden",
}
_ROLE = {w: r for r, words in ROLES.items() for w in words.split()}
_TAGS = frozenset("article main section div p li ul ol td table blockquote pre figure figcaption h1 h2 h3 h4 h5 h6 nav aside footer header form fieldset dialog dl dt dd a address details".split())

#: Tags and roles of what is never an article, unless an article's own tag stands inside.
_APART = frozenset("nav aside header footer form dialog".split())
_NEVER = frozenset("ad menu comment side notice foot head share form hidden".split())
_SHELLS = frozenset("article main section nav aside footer header form dialog".split())


def _bucket(n: int) -> int:
    return min(9, n.bit_length())


@dataclass
class Context:
    """What an element's own and its ancestors' tags and roles tell; children share what they don't change."""

    tags: frozenset = frozenset()
    roles: frozenset = frozenset()
    near: tuple = ()  # the two innermost known tags
    inner: tuple = ("-",)  # roles of the innermost element that has any
    shell: str = "-"


def _context(element: Element | None) -> Context:
    """Carried down from the nearest ancestor whose context is known, so each element is visited once."""
    todo = []
    while element is not None and element.context is None:
        todo.append(element)
        element = element.parent
    out = Context() if element is None else element.context
    for e in reversed(todo):
        roles = frozenset(_ROLE[w] for w in e.words if w in _ROLE)
        known = e.tag in _TAGS
        tags = out.tags if not known or e.tag in out.tags else out.tags | {e.tag}
        out = Context(tags, out.roles if roles <= out.roles else out.roles | roles, (*out.near, e.tag)[-2:] if known else out.near, tuple(sorted(roles)) or out.inner, e.tag if e.tag in _SHELLS else out.shell)
        e.context = out
    return out


def features(page: list[Block]) -> list[list[str]]:
    """Names of the features that hold for each block."""
    own = []
    for b in page:
        f = []
        here = _context(b.element)
        roles, tags, near = here.roles, here.tags, here.near
        f += [f"inner:{r}" for r in here.inner]
        f.append(f"shell:{here.shell}")
        f += [f"in:{t}" for t in tags]
        f += [f"role:{r}" for r in roles]
        f.append(f"tag:{near[-1] if near else '-'}")
        f.append(f"parents:{'>'.join(near[-2:])}")
        if "article" in tags or "main" in tags:
            f.append("home")
            f += [f"home+role:{r}" for r in roles]
            f += [f"home+in:{t}" for t in tags & {"header", "nav", "aside", "footer", "form", "section", "dialog"}]
        elif "main" not in roles:
            f.append("no home")
        if roles and "main" not in roles:
            f.append("odd role")
        n = len(b.text)
        f.append(f"size:{_bucket(n // 8)}")
        share = b.linked / max(1, n)
        f.append("links:" + ("0" if share == 0 else "1" if share < 0.3 else "2" if share < 0.8 else "3"))
        if b.text[-1] in ".!?:;":
            f.append("stop")
        if b.text[0] == "©" or "©" in b.text[:20]:
            f.append("copyright")
        if not any(c.isalpha() for c in b.text):
            f.append("no letters")
        own.append((f, roles, b.element))
    out = []
    for i, (f, _, element) in enumerate(own):
        f = list(f)
        near = min(i, len(own) - 1 - i)
        f.append(f"blocks:{_bucket(len(own))}")
        if near < 3:
            f.append(f"{'start' if i == near else 'end'}:{near}")
            f += [f"{'start' if i == near else 'end'}:{near}+{x}" for x in own[i][0] if x.startswith(("size:", "links:", "tag:", "no home"))]
        shape = [x for x in f if x.startswith(("size:", "links:"))]
        f.append("+".join(shape))
        f += [f"{shape[1]}+{x}" for x in f if x.startswith(("tag:", "home", "no home", "stop")) and "+" not in x]
        if i == 0:
            f.append("first")
        else:
            f += [f"before:role:{r}" for r in own[i - 1][1]]
            f += [f"before:{x}" for x in own[i - 1][0] if x.startswith(("size:", "links:", "tag:", "stop"))]
            before = own[i - 1][2]
            f.append("same parent" if element is before or element and before and element.parent is before.parent else "new parent")
        if i + 1 == len(own):
            f.append("last")
        else:
            f += [f"after:role:{r}" for r in own[i + 1][1]]
            f += [f"after:{x}" for x in own[i + 1][0] if x.startswith(("size:", "links:", "tag:", "stop"))]
        out.append(f)
    return out


@dataclass
class Field:
    """weights: feature -> (score of 1) - (score of 0); moves[a][b]: of label b after a; start: of label 1 at first."""

    weights: dict[str, float]
    moves: np.ndarray
    start: float

    def decode(self, page: list[Block]) -> list[bool]:
        """Viterbi over the page's blocks; if nothing is inside, over the labellings that have an open block inside, if there is any."""
        if not page:
            return []
        u = [sum([self.weights.get(x, 0.0) for x in f]) for f in features(page)]
        best = self.viterbi(u, [])
        if any(best):
            return best
        open_ = [is_open(b) for b in page]
        return self.viterbi(u, open_) if any(open_) else best

    def viterbi(self, u: list[float], needed: list[bool]) -> list[bool]:
        """The best labelling for the scores u of label 1; with `needed`, the best of those that give 1 to one of its blocks at least."""
        m = self.moves.tolist()
        # states: label, and whether a needed block has had label 1
        last = {(0, not needed): 0.0}
        if not needed:
            last[1, True] = u[0] + self.start
        else:
            last[1, needed[0]] = u[0] + self.start
        back = []
        for i in range(1, len(u)):
            now, step = {}, {}
            for (a, had), score in last.items():
                for b in (0, 1):
                    state = (b, had or bool(b and needed and needed[i]))
                    total = score + m[a][b] + (u[i] if b else 0.0)
                    if state not in now or total > now[state]:
                        now[state], step[state] = total, (a, had)
            last = now
            back.append(step)
        state = max((s for s in last if s[1]), key=lambda s: (last[s], -s[0]))
        out = [bool(state[0])]
        for step in reversed(back):
            state = step[state]
            out.append(bool(state[0]))
        return out[::-1]


def is_open(b: Block) -> bool:
    """Whether a block stands outside every landmark that is never an article's, and isn't links alone."""
    here = _context(b.element)
    return not here.roles & _NEVER and not here.tags & _APART and b.linked < 0.8 * len(b.text)


def train(pages: list[tuple[str, list[tuple[int, int]]]], steps: int = 200, rate: float = 0.08, penalty: float = 2e-4) -> Field:
    """pages: (html, source spans of the article)."""
    rows, labels = [], []
    for html, spans in pages:
        page = blocks(html)
        if page:
            rows.append(features(page))
            labels.append([any(a <= b.start < z for a, z in spans) for b in page])
    names = {f: k for k, f in enumerate(sorted({f for page in rows for fs in page for f in fs}))}
    n, t, k = len(rows), max(map(len, rows)), len(names)
    real, y = np.zeros((n, t), bool), np.zeros((n, t), int)
    cell, which = [], []
    for i, page in enumerate(rows):
        real[i, : len(page)] = True
        y[i, : len(page)] = labels[i]
        for j, fs in enumerate(page):
            cell += [i * t + j] * len(fs)
            which += [names[f] for f in fs]
    cell, which = np.array(cell), np.array(which)
    theta = np.zeros(k + 5)  # weights, moves, start
    first, second = np.zeros(k + 5), np.zeros(k + 5)
    total = real.sum()
    for step in range(1, steps + 1):
        u = np.bincount(cell, theta[which], n * t).reshape(n, t)
        moves, start = theta[k : k + 4].reshape(2, 2), theta[k + 4]
        alpha, beta = np.zeros((t, n, 2)), np.zeros((t, n, 2))
        score = np.stack([np.zeros((n, t)), u], axis=2)
        alpha[0] = score[:, 0]
        alpha[0][:, 1] += start
        for j in range(1, t):
            new = np.logaddexp(alpha[j - 1][:, :1] + moves[0], alpha[j - 1][:, 1:] + moves[1]) + score[:, j]
            alpha[j] = np.where(real[:, j, None], new, alpha[j - 1])
        for j in range(t - 2, -1, -1):
            ahead = beta[j + 1] + score[:, j + 1]
            new = np.logaddexp(ahead[:, :1] + moves[:, 0], ahead[:, 1:] + moves[:, 1])
            beta[j] = np.where(real[:, j + 1, None], new, 0.0)
        z = np.logaddexp(alpha[-1][:, 0], alpha[-1][:, 1])
        p = np.exp(np.minimum(alpha + beta - z[None, :, None], 0)).transpose(1, 0, 2)
        wrong = np.where(real, y - p[:, :, 1], 0.0)
        grad = np.zeros(k + 5)
        grad[:k] = np.bincount(which, wrong.ravel()[cell], k)
        both = real[:, 1:]
        for a in (0, 1):
            for b in (0, 1):
                pair = np.exp(np.minimum(alpha[:-1, :, a].T + moves[a, b] + score[:, 1:, b] + beta[1:, :, b].T - z[:, None], 0))
                seen = (y[:, :-1] == a) & (y[:, 1:] == b)
                grad[k + 2 * a + b] = ((seen - pair) * both).sum()
        grad[k + 4] = wrong[:, 0].sum()
        grad = grad / total - penalty * theta
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Field({f: float(theta[i]) for f, i in names.items()}, theta[k : k + 4].reshape(2, 2), float(theta[k + 4]))


def made_pages(n: int = TRAIN_PAGES, seed: int = SEED) -> list[tuple[str, list[tuple[int, int]]]]:
    maker = PageMaker(seed)
    return [maker.page() for _ in range(n)]


@cache
def default_field() -> Field:
    """The field trained on made pages; the same in every process."""
    return train(made_pages())


def main_text(html: str | None, field: Field) -> str:
    page = blocks(html or "")
    return "\n".join(b.text for b, keep in zip(page, field.decode(page), strict=True) if keep)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars: one row per page."""
    field = field or default_field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), field) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.col("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
