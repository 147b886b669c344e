"""Labelled pages: small web pages whose main text is marked, as examples for the extraction's decision tree.

Texts are counted words; what matters are lengths, links, tags and names. Among them are misleading names and tags: a story in a container named
after its subject, notices inside of articles, long adverts and comments, pages without any article.
"""

from __future__ import annotations

#: Marks a block of main text.
MAIN = ""


def text(n: int) -> str:
    return " ".join(["word"] * n)


def p(n: int, tag: str = "p", attributes: str = "") -> str:
    return f"<{tag}{attributes}>{MAIN}{text(n)}</{tag}>"


def aside(n: int, tag: str = "p", attributes: str = "") -> str:
    return f"<{tag}{attributes}>{text(n)}</{tag}>"


def links(n: int, words: int = 1, tag: str = "li") -> str:
    return "".join(f"<{tag}><a href='/{i}'>{text(words)}</a></{tag}>" for i in range(n))


def nav(n: int) -> str:
    return f"<nav><ul>{links(n)}</ul></nav>"


_FOOT = "<footer>&copy; site.com &middot; {}</footer>"


class Sizes:
    """Lengths of texts, from a fixed sequence: short ones (titles, captions), paragraphs of one to some hundred words."""

    def __init__(self, seed: int):
        self.state = 2 * seed + 1

    def below(self, n: int) -> int:
        self.state = self.state * 6364136223846793005 + 1442695040888963407 & (1 << 64) - 1
        return (self.state >> 33) % n

    def short(self) -> int:
        return 1 + self.below(12)

    def body(self) -> int:
        return 1 + self.below((6, 20, 60, 180)[self.below(4)])

    def story(self) -> str:
        return p(self.short(), "h1") + "".join(p(self.body()) for _ in range(1 + self.below(7)))

    def box(self, tag: str = "p") -> str:
        return "".join(aside(self.body(), tag) for _ in range(1 + self.below(3)))


def _plain(s: Sizes) -> list[str]:
    """A menu, an advert, an article and a footer."""
    foot = _FOOT.format(text(s.body()))
    return [
        f"<body>{nav(3 + s.below(6))}{aside(s.body(), 'div', mark)}<article>{s.story()}</article>{foot}</body>" for mark in (" class='ad'", " id='ad-slot'")
    ] + [f"<div class='page'>{nav(2 + s.below(9))}<main>{s.story()}</main></div>{foot}"]


def _dressed(s: Sizes) -> list[str]:
    """Notices, forms, sidebars and readers' comments around and inside the main text."""
    head = f"<header><h1>{text(s.short())}</h1>{s.box()}</header><div class='cookie-notice'>{s.box()}</div>"
    ask = f"<form><label>Name</label><input>{s.box()}</form>"
    side = f"<aside><h3>{text(s.short())}</h3>{s.box()}<ul>{links(4, 5)}</ul></aside>"
    comments = f"<section id='comments'><h3>{text(1)}</h3>{s.box()}{s.box()}</section>"
    wide = f"<div class='sidebar'>{s.box()}</div>"
    share = "<div class='share'>" + links(3, 1, "span") + "</div>"
    return [
        f"{head}{nav(5)}<main>{s.story()}{p(s.short(), 'h2')}{p(s.body())}</main>{side}{ask}{_FOOT.format(text(6))}",
        f"{nav(3)}<article>{s.story()}<div class='advert'>{s.box()}</div>{p(s.body())}{comments}</article>{wide}{ask}",
        f"{head}<article><header>{p(s.short(), 'h1')}</header>{p(s.body())}{share}{p(1)}<p class='newsletter'>{text(s.body())}</p>{p(s.body())}{side}</article>{comments}",
        f"<div class='site-header'>{s.box('h2')}</div><div class='story-body'>{s.story()}<ul>{p(6, 'li')}{p(9, 'li')}{p(s.short(), 'li')}</ul>{p(2)}</div><div class='related'>{s.box()}{links(5, 6)}</div>",
        f"{nav(6)}<article>{s.story()}<table><tr>{p(2, 'td')}{p(1, 'td')}</tr><tr>{p(3, 'td')}{p(2, 'td')}</tr></table><pre>{MAIN}{text(15)}</pre><blockquote>{MAIN}{text(s.body())}</blockquote>"
        f"<p>{MAIN}{text(4)} <a href='x'>{text(s.short())}</a></p><ol><li>{MAIN}<a href='x'>{text(4)}</a></li><li>{MAIN}<a href='y'>{text(s.short())}</a></li></ol></article>{side}",
    ]


def _misleading(s: Sizes) -> list[str]:
    """Names that say something else than they seem to."""
    return [
        f"<body class='has-sidebar nav-open'><div>{p(40 + s.body(), 'div')}</div></body>",
        f"<body class='menu ads'>{nav(4)}<article>{s.story()}</article></body>",
        f"<div id='comments-on-war'><article>{s.story()}</article></div>",
        f"<div class='comments'><div>{s.box()}{s.box()}</div></div><article>{s.story()}</article>",
        f"<article class='story legal'>{s.story()}</article>",
        f"<article>{s.story()}<div class='side effects'>{p(s.body())}{p(s.body())}</div><p class='promo-code-guide'>{MAIN}{text(s.body())}</p>{p(9)}</article>",
        f"<div class='widget-maker profile'>{p(7, 'h1')}{p(40 + s.body())}{p(30 + s.body())}</div>{nav(5)}",
    ]


def _bare(s: Sizes) -> list[str]:
    """Pages without an article: long blocks, and what stands between them."""
    menu = "".join(f"<div><a href='/{i}'>{text(1 + i % 2)}</a></div>" for i in range(3 + s.below(5)))
    long = lambda: 25 + s.below(150)
    row = lambda: "<div>" + "".join(f"<a href='/{i}'>{text(1 + i % 2)}</a> " for i in range(1 + s.below(6))) + "</div>"
    return [
        f"{row()}<div>{MAIN}{text(long())}</div>{p(s.short(), 'div')}{p(long(), 'div')}{row()}",
        f"{row()}{row()}{p(long())}{p(s.short())}{p(long())}{row()}",
        f"<table><tr><td>{row()}</td></tr></table><div>{p(long())}{p(long())}</div>{row()}{row()}",
        f"<div>{menu}</div><div>{p(long(), 'div')}{p(s.short(), 'div')}{p(long(), 'div')}</div><div><a>{text(1)}</a></div>",
        f"<div>{menu}</div>{p(s.short(), 'h1')}{p(long())}{p(long())}{p(s.short(), 'h2')}{p(long())}<div>{links(6, 3, 'p')}</div>",
        p(long()), f"{MAIN}{text(long())}", f"{p(s.short(), 'h1')}{MAIN}{text(long())}", p(s.body()), p(s.short(), "div"),
        f"{p(long())}{p(long())}<ul>{links(9, 4)}</ul><p><a>{text(2)}</a> {text(2)}</p>",
        f"<ul>{links(12, 2)}</ul><ul>{links(8, 5)}</ul>",
        f"<div><a href='/'>{text(2)}</a></div><div>{p(long())}{p(s.body())}{p(long())}</div><div>{links(3, 2, 'div')}</div>",
        f"<table><tr><td>{links(4, 1, 'div')}</td><td>{p(long())}{p(s.body())}{p(long())}</td></tr></table>",
    ]


def _dense(s: Sizes) -> list[str]:
    """Blocks and lists of links, and links around whole blocks."""
    return [
        "<div>" + " ".join(f"<a href='/{i}'>{text(1 + s.below(4))}</a>" for i in range(8 + s.below(20))) + "</div>", f"<div>{links(6 + s.below(12), 2 + s.below(5), 'p')}</div>",
        f"<ul>{links(5 + s.below(12), 1 + s.below(6))}</ul>", f"<a href='/'><div>{text(20 + s.below(160))}</div></a>", f"<div><a href='/'><h3>{text(1 + s.below(4))}</h3><p>{text(15 + s.below(40))}</p></a></div>",
    ]


def _linked(s: Sizes) -> list[str]:
    """Articles with paragraphs that are links alone, and with blocks and lists of links that are no part of them."""
    link = lambda: f"<p><a href='x'>{MAIN}{text(s.short())}</a></p>"
    mixed = lambda: f"<p>{MAIN}{text(1 + s.below(9))} <a href='x'>{text(1 + s.below(9))}</a></p>"
    return [
        f"{nav(4)}<article>{s.story()}{mixed()}{p(s.body())}{mixed()}{mixed()}</article><ul>{links(5, 3)}</ul>", f"<article>{p(s.short(), 'h1')}{mixed()}{p(s.short())}{mixed()}</article>",
        f"{nav(4)}<article>{s.story()}{link()}{p(s.body())}{link()}</article><ul>{links(5, 3)}</ul>",
        f"<main>{p(s.short(), 'h1')}{link()}{p(s.body())}{link()}{link()}</main><div>{links(4, 2, 'p')}</div>{_FOOT.format(text(s.body()))}",
        *[f"{nav(3)}<article>{s.story()}{x}{p(s.body())}</article>" for x in _dense(s)], *[f"<main><div>{s.story()}</div>{x}</main>" for x in _dense(s)],
    ]


def _open(s: Sizes) -> list[str]:
    """A story in plain containers, with one long block of something else beside it, before or after; and a short last paragraph."""
    long = lambda: 20 + s.below(160)
    short = lambda: 1 + s.below(4)
    said = lambda: aside(long()) if s.below(2) else aside(long(), "div")
    beside = [
        f"<footer>{said()}</footer>", f"<footer>{text(long())}</footer>", f"<aside>{said()}{said()}</aside>", f"<aside>{text(long())}</aside>", f"<nav>{said()}</nav>", f"<form>{said()}<input></form>",
        *[f"<div class='{c}'>{said()}</div>" for c in ("cookie-notice", "ad", "sidebar", "newsletter-box", "disclaimer", "related", "promo")],
        f"<div id='comments'>{said()}{said()}</div>", f"<div id='respond' class='comment-respond'>{said()}</div>", f"<section class='comments'>{said()}{aside(short())}{said()}</section>",
        f"<div style='display:none'>{said()}</div>", f"<div role='complementary'>{said()}</div>", f"<ul><li class='ad'><div>{text(long())}</div></li></ul>",
        *_dense(s),
    ]
    out = []
    for k, other in enumerate(beside):
        heading = p(s.short(), ("h1", "h2", "div")[s.below(3)])
        linked = f"<p>{MAIN}{text(5 + s.below(30))} <a href='x'>{text(1 + s.below(20))}</a> {text(s.short())}</p>"
        story = heading + "".join(p(long() if s.below(4) else s.short()) for _ in range(2 + s.below(4))) + (linked if s.below(2) else "") + p(long()) + p(short())
        box = f"<div>{story}</div>" if s.below(2) else story
        out.append(f"{nav(4)}{box}{other}" if k % 2 else f"{other}{box}{aside(short(), 'footer')}")
        if k % 3 == 0:  # the same inside the story
            out.append(f"<div>{heading}{p(long())}{p(long())}{other}{p(long())}{p(short())}</div>")
    return out


def untagged(page: str) -> str:
    """The page with its article tags and names taken off."""
    for name in ("article", "main"):
        page = page.replace(f"<{name}>", "<div>").replace(f"</{name}>", "</div>")
    return page.replace("<article class='story legal'>", "<div class='legal'>").replace("class='story-body'", "class='body'")


def pages(rounds: int = 6) -> list[str]:
    out = []
    for k in range(rounds):
        plain, dressed = _plain(Sizes(k)), _dressed(Sizes(k))
        out += [*plain, *dressed, *_misleading(Sizes(k)), *_bare(Sizes(k)), *_linked(Sizes(k)), *_open(Sizes(k)), *_open(Sizes(k + rounds))]
        # without tags nobody can tell the last dressed page's list of links from a menu: it stays out
        out += [untagged(x) for x in (*plain, *dressed[:4], *_misleading(Sizes(k)))]
    return out
