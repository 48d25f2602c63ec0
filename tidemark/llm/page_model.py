"""Generated pages with known labels, and the extraction model fitted to them.

There are no labelled pages to learn from, so pages are made: layouts with and
without an article element, with telling, missing and misleading class
names, in invented words.  The number of pages is a parameter and fixed, and
so is the random seed; fitting takes about a second and always gives the
same model.
"""

from __future__ import annotations

import random
from functools import cache

import numpy as np

from tidemark.llm.html_extract import FEATURES, Model, Page, features

#: Pages to fit the weights on, and to choose the ties on.
TRAINING, CHOOSING = 400, 200
#: The most a terminal carries, in log odds.
MOST = 5.0
_SYLLABLES = "an ba ce do el fi go hu in ja ko la me no os pa qu re si ta un ve wi yo ze ün ée ña".split()
_TALK = "newsletter cookies subscribe sponsored privacy-policy advertise login".split()
_NEUTRAL = "c1 x-7 wrap css-1a2b grid col-8 t3 outer row inner u-mt k9".split()
_HALF = "footer-bottomline ad-leaderboard cookie-law sidebar-primary social-icons2 menu-toggle newsletter-hero related-stories".split()
_MISLEADING = "main-menu-history social-science comment-free search-party header-bidding-study legal-history sponsored-research-ethics banner-carriers related-work reply-culture".split()


class Maker:
    """Random pages; ``parts`` lists (text, is content) of what was put in."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.parts: list[tuple[str, bool]] = []

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self, low: int = 4, high: int = 25) -> str:
        return self.words(low, high).capitalize() + self.r.choice("...?!")

    def prose(self) -> str:
        kind = self.r.random()
        if kind < 0.06:
            return f"{self.words(1, 8)} {self.r.choice(_TALK).replace('-', ' ')} {self.sentence(1, 9)}"
        if kind < 0.25:
            return self.sentence(1, 5)
        if kind < 0.32:
            return self.words(1, 12)
        return " ".join(self.sentence() for _ in range(self.r.randint(1, 6)))

    def add(self, text: str, content: bool) -> str:
        self.parts.append((" ".join(text.split()), content))
        return text

    def attr(self, names: list[str]) -> str:
        return f' class="{self.r.choice(names)}"' if self.r.random() < 0.5 else ""

    def linked(self, n: int, low: int = 1, high: int = 3) -> str:
        items = []
        for _ in range(n):
            items.append(f'<li><a href="/{self.word()}">{self.add(self.words(low, high), False)}</a></li>')
        return f"<ul>{''.join(items)}</ul>"

    def content(self, misleading: bool) -> str:
        names = _MISLEADING if misleading else _NEUTRAL
        out = [f"<h1>{self.add(self.words(2, 9), True)}</h1>"]
        for _ in range(self.r.randint(2, 9)):
            kind = self.r.random()
            if kind < 0.72:
                out.append(f"<p{self.attr(names)}>{self.add(self.prose(), True)}</p>")
            elif kind < 0.8:
                out.append(f"<h2>{self.add(self.words(1, 6), True)}</h2>")
            elif kind < 0.88:
                items = "".join(f"<li>{self.add(self.prose(), True)}</li>" for _ in range(self.r.randint(1, 4)))
                out.append(f"<ul>{items}</ul>")
            elif kind < 0.94:
                text = self.words(3, 8)
                out.append(f'<p><a href="/x">{text}</a> {(rest := self.words(2, 8))}.</p>')
                self.add(f"{text} {rest}.", True)
            else:
                out.append(f"<blockquote{self.attr(names)}><p>{self.add(self.prose(), True)}</p></blockquote>")
        return "".join(out)

    def inside(self, telling: bool) -> str:
        """Something in the middle of an article that is not of it."""
        kind = self.r.randrange(4) if telling else 4
        if kind == 0:
            return f'<div class="{self.r.choice(["ad", "ad-slot", "advert", "sponsored"])}">{self.add(self.prose(), False)}</div>'
        if kind == 1:
            return f'<aside><p>{self.add(self.prose(), False)}</p></aside>'
        if kind == 2:
            return f'<div class="{self.r.choice(["share-buttons", "social", "newsletter-signup", "related-posts"])}"><p>{self.add(self.prose(), False)}</p></div>'
        if kind == 3:
            return f'<section id="comments"><p>{self.add(self.prose(), False)}</p><p>{self.add(self.prose(), False)}</p></section>'
        said = self.r.choice(["Sign up for our newsletter and get the latest stories.", "Subscribe for more of this in your inbox.", "Enter your email to read on.", self.sentence()])
        return f"<div><p>{self.add(said, False)}</p><form><input name=e><button>Go</button></form></div>"

    def around(self, tags: bool, telling: bool) -> tuple[str, str]:
        """What stands before and after the content."""

        def wrap(tag: str, names: list[str], body: str) -> str:
            if tags and self.r.random() < 0.6:
                return f"<{tag}>{body}</{tag}>"
            name = f' class="{self.r.choice(names if self.r.random() < 0.8 else _HALF)}"' if telling else self.attr(_NEUTRAL)
            return f"<div{name}>{body}</div>"

        before, after = [], []
        if self.r.random() < 0.9:
            before.append(wrap("nav", ["menu", "nav", "navbar", "main-menu", "site-nav"], self.linked(self.r.randint(2, 8))))
        if self.r.random() < 0.5:
            before.append(wrap("header", ["header", "masthead", "topbar"], f"<p>{self.add(self.words(1, 5), False)}</p>"))
        if self.r.random() < 0.4:
            said = self.r.choice(["We use cookies to make this site better.", "This site uses cookies. Read more in our privacy policy.", self.sentence()])
            before.append(f'<div class="cookie-notice">{self.add(said, False)}</div>' if telling else f"<div><p>{self.add(said, False)}</p><button>OK</button></div>")
        if self.r.random() < 0.4 and telling:
            before.append(f'<div class="ad">{self.add(self.sentence(), False)}</div>')
        if self.r.random() < 0.5:
            after.append(wrap("aside", ["sidebar", "widget", "sidebar-right"], f"<h3>{self.add(self.words(1, 3), False)}</h3>{self.linked(self.r.randint(2, 6), 3, 9)}"))
        if self.r.random() < 0.3 and telling:
            after.append(f'<div class="comments"><p>{self.add(self.prose(), False)}</p><p>{self.add(self.prose(), False)}</p></div>')
        if self.r.random() < 0.9:
            said = self.r.choice([f"© {self.words(1, 4)}", f"© {self.words(1, 3)}. All rights reserved.", f"{self.words(1, 3)} · {self.words(1, 3)}", self.sentence(3, 12)])
            after.append(wrap("footer", ["footer", "site-footer", "copyright"], f"<p>{self.add(said, False)}</p>"))
        return "".join(before), "".join(after)

    def bare(self) -> str:
        """A page of a few words or of paragraphs, and nothing else."""
        if self.r.random() < 0.5:
            return f"<p>{self.add(self.words(1, 6), True)}"
        return self.content(False)

    def page(self, layout: int) -> str:
        """Layouts: 0 elements, 1 telling classes, 2 nothing telling, 3 elements and misleading classes, 4 content alone."""
        self.parts = []
        tags, telling, misleading = layout in (0, 3), layout != 2, layout == 3
        if layout == 4:
            return f"<html><body>{self.bare()}</body></html>"
        named = telling and not (tags and self.r.random() < 0.5)
        before, after = self.around(tags and named, named)
        body = self.content(misleading)
        if self.r.random() < 0.5:
            body += self.inside(telling and self.r.random() < 0.8)
            if self.r.random() < 0.7:
                body += f"<p>{self.add(self.prose(), True)}</p>"
        if tags:
            inner = f"<{(t := self.r.choice(['article', 'main']))}{self.attr(_MISLEADING if misleading else _NEUTRAL)}>{body}</{t}>"
        else:
            name = f' class="{self.r.choice(["content", "post", "article-body", "entry-content", "story"])}"' if telling else self.attr(_NEUTRAL)
            inner = f"<div{name}>{body}</div>"
        return f"<html><body>{before}{inner}{after}</body></html>"


def labelled(n: int, seed: int, layouts: tuple[int, ...] = (0, 1, 2, 3, 4)) -> list[tuple[Page, np.ndarray]]:
    """``n`` generated pages with the label of each block."""
    maker, out = Maker(seed), []
    for k in range(n):
        page = Page(maker.page(layouts[k % len(layouts)]))
        kinds: dict[str, bool] = {}
        for text, content in maker.parts:
            kinds[text] = kinds.get(text, False) or content
        out.append((page, np.array([kinds.get(b.text, False) for b in page.blocks], dtype=bool)))
    return out


def fit_weights(pages: list[tuple[Page, np.ndarray]], ridge: float = 0.3, rounds: int = 25) -> np.ndarray:
    """Logistic regression by Newton steps."""
    x = np.concatenate([features(p) for p, _ in pages])
    y = np.concatenate([labels for _, labels in pages]).astype(np.float64)
    w = np.zeros(len(FEATURES))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w.round(6)


def accuracy(model: Model, pages: list[tuple[Page, np.ndarray]]) -> float:
    right = sum(int((np.array(model.labels(p), dtype=bool) == y).sum()) for p, y in pages)
    return right / sum(len(y) for _, y in pages)


@cache
def fitted(training: int = TRAINING, choosing: int = CHOOSING) -> Model:
    """The model: weights from one set of pages, ties that label another one best (the weakest of equals)."""
    weights = fit_weights(labelled(training, seed=1))
    pages = labelled(choosing, seed=2)
    grid = [Model(weights, MOST, a, b) for a in (0.25, 0.5, 0.75, 1.0) for b in (0.25, 0.5, 0.75, 1.0, 1.5)]
    scores = [accuracy(m, pages) for m in grid]
    return grid[int(np.argmax(scores))]
