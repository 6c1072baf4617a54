"""Labelled pages to train on: invented pages of many layouts whose block elements say whether they are content (data-y)."""

from __future__ import annotations

import random
import re

_VOWELS, _CONSONANTS = "aeiou", "bcdfghklmnprstvwz"
_CHROME = {
    "nav": "nav navbar menu navigation topnav main-menu breadcrumb breadcrumbs pagination pager skip links site-nav dropdown tabs toolbar".split(),
    "header": "header masthead topbar site-header page-header branding logo banner site-title tagline hero-bar".split(),
    "footer": "footer site-footer bottom copyright legal colophon footnav credits".split(),
    "aside": "sidebar aside widget widgets rail secondary side-column related recommended more-stories trending popular promo teaser tags social share sharing author-box".split(),
    "ad": "ad ads advert adverts advertisement sponsor sponsored adsense banner-ad promo promoted dfp outbrain taboola affiliate".split(),
    "notice": "notice cookie cookies cookie-notice consent gdpr alert warning popup modal overlay paywall newsletter subscribe announcement".split(),
    "form": "form search login signup search-form contact subscribe-form newsletter-form poll survey".split(),
    "comments": "comments comment comment-list respond discussion disqus replies reply responses reader-comments reviews guestbook".split(),
}
_CONTENT = "article post entry content main story article-body post-content entry-content page-content body text main-content body-text story-body prose".split()
_NEUTRAL = "container wrapper row col inner page wrap layout section block box outer grid clearfix site".split()

_ANYWHERE = "message note warning alert tip lead intro highlight caption summary quote link contact social tags notice banner related form comment".split()

_NAMED = re.compile(r' (?:class|id|role)=(?:"[^"]*"|[^\s>]+)')


def labelled_pages(n: int, seed: int = 11) -> list[str]:
    r = random.Random(seed)
    return [_page(r) for _ in range(n)]


def _word(r: random.Random) -> str:
    return "".join(r.choice(_CONSONANTS) + r.choice(_VOWELS) for _ in range(r.randint(1, 4)))


def _words(r: random.Random, a: int, b: int, stops: bool = False) -> str:
    out = [_word(r) for _ in range(r.randint(a, b))]
    if stops:
        for k in range(len(out)):
            if r.random() < 0.1:
                out[k] += r.choice([".", ".", ",", "!", "?"])
        out[-1] += "."
    return " ".join(out).capitalize()


def _open(r: random.Random, tag: str, y: int, names: list[str], often: float = 0.8) -> str:
    attributes = ""
    if names and r.random() < often:
        key = r.choice(["class", "class", "id", "role"]) if len(names) == 1 else "class"
        attributes = f' {key}="{" ".join(names)}"'
    return f"<{tag} data-y={y}{attributes}>"


def _link(r: random.Random, a: int = 1, b: int = 3) -> str:
    return f'<a href="/{_word(r)}">{_words(r, a, b)}</a>'


def _chrome(r: random.Random, kind: str) -> str:
    tag = {"nav": ["nav", "nav", "div", "ul"], "header": ["header", "header", "div"], "footer": ["footer", "footer", "div"], "aside": ["aside", "aside", "div", "section"], "ad": ["div", "div", "aside", "section", "ins-ad"], "notice": ["div", "div", "section", "aside", "p"], "form": ["form", "form", "div"], "comments": ["section", "div", "div", "ol"]}[kind]
    tag = r.choice(tag)
    plain = tag not in ("div", "section", "p", "ul", "ol", "ins-ad")
    out = [_open(r, tag, 0, [r.choice(_CHROME[kind])], 0.6 if plain else 1.0)]
    if tag == "p":
        return out[0] + _words(r, 5, 25, True) + "</p>"
    if kind in ("nav", "header", "footer") or kind == "aside" and r.random() < 0.5:
        if kind == "header" and r.random() < 0.6:
            out.append(f"<h1 data-y=0>{_words(r, 1, 4)}</h1><p data-y=0>{_words(r, 2, 9)}</p>")
        items = "".join(f"<li data-y=0>{_link(r)}{'' if r.random() < 0.5 else '</li>'}" for _ in range(r.randint(2, 9)))
        out.append(items if tag in ("ul", "ol") else r.choice([f"<ul data-y=0>{items}</ul>", " ".join(_link(r) for _ in range(r.randint(2, 8))), _words(r, 2, 10), f"<p data-y=0>{_words(r, 3, 14, True)}</p>"]))
    elif kind == "form":
        out.append(f"<label>{_words(r, 1, 3)}</label><input type=text><p data-y=0>{_words(r, 2, 8)}</p><button data-y=0>{_words(r, 1, 2)}</button>")
    elif kind == "comments":
        out.append(f"<h3 data-y=0>{_words(r, 1, 3)}</h3>")
        for _ in range(r.randint(1, 6)):
            inner = ("article" if r.random() < 0.03 else r.choice(["div", "div", "li"])) if tag != "ol" else "li"
            out.append(f"<{inner} data-y=0{r.choice([' class=comment', ' class=reply', '']) if inner != 'article' else ' class=comment'}><p data-y=0>{_words(r, 5, 60, True)}</p></{inner}>")
    else:
        parts = [f"<p data-y=0>{_words(r, 4, 40, True)}</p>", _words(r, 3, 30, True), f"<h4 data-y=0>{_words(r, 1, 5)}</h4>{_link(r, 3, 9)}", f"<div data-y=0>{_link(r, 2, 6)}</div>"]
        out.extend(r.choice(parts) for _ in range(r.randint(1, 3)))
    return "".join(out) + f"</{tag}>"


def _body(r: random.Random) -> str:
    out = []
    if r.random() < 0.8:
        title = f"<h1 data-y=1>{_words(r, 2, 9)}</h1>"
        out.append(r.choice([title, title, f"<header data-y=1>{title}<p data-y=1>{_words(r, 4, 15, True)}</p></header>"]))
    drone = r.random() < 0.3  # some articles are lists of words without a full stop, or of lines of a few words
    short = 0.9 if r.random() < 0.2 else 0.15
    block = "div" if r.random() < 0.1 else "p"
    for _ in range(r.choice([1, 1, 2, 3, 4, 6, 9, 14, 25])):
        x = r.random()
        if x < 0.62:
            text = _words(r, 1, 6, True) if r.random() < short else _words(r, 8, 110, not drone)
            if r.random() < 0.25:
                text += f" {_link(r)} {_words(r, 3, 20, True)}"
            named = ""
            if r.random() < 0.15:  # words that stand on chrome elsewhere, or that no list has, on a paragraph of the article
                named = f' class="{r.choice(_ANYWHERE) if r.random() < 0.7 else _word(r)}"'
            out.append(f"<{block} data-y=1{named}>{text}{f'</{block}>' if block == 'div' or r.random() < 0.8 else ''}")
        elif x < 0.70:
            out.append(f"<h{(k := r.randint(2, 4))} data-y=1>{_words(r, 1, 6)}</h{k}>")
        elif x < 0.78:
            out.append("<ul data-y=1>" + "".join(f"<li data-y=1>{_words(r, 2, 25, True)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
        elif x < 0.83:
            out.append(f"<blockquote data-y=1>{r.choice(['{}', '<p data-y=1>{}</p>']).format(_words(r, 6, 40, True))}</blockquote>")
        elif x < 0.87:
            out.append("<table data-y=1>" + "".join(f"<tr data-y=1><td data-y=1>{_words(r, 1, 4)}</td><td data-y=1>{_words(r, 1, 6)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>")
        elif x < 0.90:
            out.append(f"<div data-y=1><p data-y=1>{_words(r, 10, 60, True)}</p></div>")
        elif x < 0.93:
            out.append(f"<pre data-y=1>{_words(r, 5, 30)}</pre>")
        else:
            out.append(_chrome(r, r.choice(["ad", "notice", "aside", "form", "nav"])))
    return "".join(out)


def _page(r: random.Random) -> str:
    plain = r.random() < 0.2  # a page without class or id words: what tells is where links and sentences are
    tag = r.choice(["div", "div", "section"] if plain else ["article", "article", "article", "main", "div", "section"])
    names = [r.choice(_CONTENT)]
    bare = r.random() < 0.07
    content = _body(r) if bare else _open(r, tag, 1, names, 0.5 if tag in ("article", "main") else 0.95) + _body(r) + f"</{tag}>"
    if r.random() < 0.15:
        content = f"<main data-y=1>{content}</main>" if tag != "main" and not bare else content
    before = [_chrome(r, k) for k in (("nav", "form") if plain else ("notice", "header", "nav", "ad", "form")) if r.random() < 0.5]
    after = [_chrome(r, k) for k in (("form", "nav") if plain else ("aside", "ad", "comments", "form", "nav", "footer")) if r.random() < 0.5]
    r.shuffle(before)
    page = "".join(before) + content + "".join(after)
    for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
        page = _open(r, "div", 0, [r.choice(_NEUTRAL)]) + page + "</div>"
    page = _NAMED.sub("", page) if plain else page
    return f"<!DOCTYPE html><html data-y=0><head data-y=0><title data-y=0>x</title></head><body data-y=0>{page}</body></html>"
