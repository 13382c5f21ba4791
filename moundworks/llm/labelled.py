"""Labelled pages to learn from: the usual layouts of articles and of what stands around them, in
invented words. ``data-main`` marks what is main text (1) and what is not (0), for all that is inside.
"""

from __future__ import annotations

import random

from moundworks.llm.dom import MARK

# What surrounds an article, by kind: (tag, attribute and its values).
AROUND = {
    "header": ("header:", "div:class=header site-header page-header masthead top-bar topbar branding logo site-title hero-bar", "div:id=header top masthead branding", "header:role=banner", "header:class=site-header page-header", "div:role=banner"),
    "menu": ("nav:", "div:class=nav menu navbar navigation main-menu topnav subnav breadcrumb breadcrumbs pagination pager toc", "ul:class=menu nav navbar breadcrumb pagination links", "div:id=nav menu navigation navbar", "nav:class=main-nav breadcrumb pagination", "div:role=navigation menubar"),
    "sidebar": ("aside:", "div:class=sidebar side-bar widget widgets related related-posts recommended popular trending most-read read-more more-stories tags tag-cloud share sharing social social-links rail right-rail teaser", "div:id=sidebar secondary related widgets", "aside:class=sidebar related widget", "section:class=related recommended popular", "div:role=complementary"),
    "notice": ("div:class=notice cookie cookie-notice cookie-banner cookies consent gdpr alert warning popup modal overlay toast announcement site-notice message disclaimer privacy-notice paywall newsletter subscribe subscription signup", "div:id=cookie-notice cookie-banner notice consent popup modal", "div:role=alert dialog alertdialog status", "section:class=notice newsletter subscribe", "aside:class=notice newsletter", "p:class=notice disclaimer alert", "dialog:"),
    "advert": ("div:class=ad ads advert adverts advertisement ad-slot ad-box ad-banner banner banner-ad sponsor sponsored sponsored-content promo promotion promoted commercial adsbygoogle dfp", "div:id=ad ads banner sponsor promo ad-top", "aside:class=ad advert promo sponsored", "section:class=ad promo sponsored", "p:class=ad advert sponsored"),
    "comments": ("section:class=comments comment-section responses discussion replies", "div:class=comments comment comment-list comment-thread replies reply reader-comments user-comments reviews discussion thread feedback", "div:id=comments respond disqus_thread discussion reader-comments", "ol:class=commentlist comment-list comments", "ul:class=comments comment-list", "section:id=comments", "aside:class=comments"),
    "form": ("form:", "form:class=search search-form login contact-form comment-form subscribe-form", "div:class=search search-box login login-form signup contact-form", "form:id=search login subscribe", "fieldset:", "div:role=search"),
    "footer": ("footer:", "div:class=footer site-footer page-footer copyright legal colophon site-info bottom credits imprint", "div:id=footer bottom colophon copyright", "footer:role=contentinfo", "footer:class=site-footer", "div:role=contentinfo"),
}
ARTICLE = (
    "article:", "article:", "main:", "article:class=post entry article story hentry", "div:class=content article article-body article-content post post-body post-content entry entry-content story story-body main-content page-content text body-text prose markdown-body rich-text", "div:id=content main article main-content story post",
    "main:id=main content", "div:class=content", "div:itemprop=articleBody", "section:class=content article-body entry-content post-content", "div:role=main article", "div:", "td:",
)
SYLLABLES = "an be ca do el fi go ha in jo ka le mo na or pa que ra se ti un va we xi yo zu é ch str ing tion lich heit mente ción ou".split()


class Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, least: int, most: int) -> str:
        """As many as log-uniform between the two."""
        n = max(least, int(least * (most / least) ** self.r.random()))
        return " ".join(self.word() for _ in range(n))

    def sentence(self, most: int = 25) -> str:
        s = self.words(1, most)
        if self.r.random() < 0.4:
            s = s.replace(" ", ", ", 1)
        if self.r.random() < 0.1:
            s += " &amp; " + self.word()
        return s[:1].upper() + s[1:] + self.r.choice([".", ".", ".", "!", "?", "", "..."])

    def prose(self, least: int = 1, most: int = 12) -> str:
        out = [self.sentence() for _ in range(max(least, int(least * (most / least) ** self.r.random())))]
        for k in range(len(out)):
            if self.r.random() < 0.12:
                tag = self.r.choice(["b", "em", "i", "strong", "span", "code", 'a href="/x"'])
                out[k] = f"<{tag}>{out[k]}</{tag.split()[0]}>"
        return " ".join(out)

    def open(self, kinds: tuple[str, ...], mark: int | None) -> tuple[str, str]:
        # by form, or evenly by value so that rare names are met often enough
        form = self.r.choice(kinds) if self.r.random() < 0.6 else self.r.choices(kinds, [k.count(" ") + 1 for k in kinds])[0]
        tag, _, rest = form.partition(":")
        name, _, values = rest.partition("=")
        attr = ""
        if name:
            v = self.r.choice(values.split())
            if name == "class" and self.r.random() < 0.3:
                v += " " + self.r.choice(["col-md-8", "row", "clearfix", "container", "wide", "block", "box-2", "inner", "js-x"])
            attr = f' {name}="{v}"'
        return f"<{tag}{attr}" + (f' {MARK}="{mark}"' if mark is not None else "") + ">", f"</{tag}>"

    def links(self) -> str:
        items = [f'<a href="/{self.word()}">{self.words(1, 5)}</a>' for _ in range(self.r.randint(2, 8))]
        return self.r.choice(["<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", " | ".join(items), "".join(f"<div>{x}</div>" for x in items)])

    def heading(self, wanted: bool = True) -> str:
        n = self.r.choice([2, 2, 3, 3, 4])
        return f"<h{n}>{self.words(1, 4)}</h{n}>" if wanted else ""

    def fields(self) -> str:
        return "".join(f'<label>{self.words(1, 4)}</label><input name="q">' for _ in range(self.r.randint(1, 4))) + f"<button>{self.words(1, 2)}</button>"

    def around(self, kind: str) -> str:
        a, b = self.open(AROUND[kind], 0)
        r = self.r.random()
        if kind == "menu":
            body = self.links()
        elif kind == "form":
            body = (f"<p>{self.sentence()}</p>" if r < 0.4 else "") + self.fields()
        elif kind == "comments":
            one = lambda: self.r.choice(["<p>{}</p>", '<div class="comment"><b>{}</b> {}</div>', "<li><cite>{}</cite><p>{}</p></li>", "<div>{}</div>"]).replace("{}", "\0", 1).replace("{}", self.prose()).replace("\0", self.prose(1, 3))
            body = self.heading(r < 0.6) + "".join(one() for _ in range(self.r.randint(1, 6))) + (f"<form>{self.fields()}</form>" if r < 0.3 else "")
        elif kind in ("header", "footer"):
            body = self.r.choice([self.links() + self.sentence(), f"<p>{self.prose(1, 3)}</p>", f"&copy; {self.words(1, 3)} &middot; {self.sentence()}", f"<h1>{self.words(1, 4)}</h1><p>{self.sentence()}</p>", self.prose(1, 2)])
        elif kind == "sidebar":
            body = self.heading(r < 0.6) + self.r.choice([self.links(), f"<p>{self.prose(1, 4)}</p>", self.prose(1, 4)])
        else:
            body = self.r.choice([self.prose(1, 3), f"<p>{self.prose(1, 4)}</p>", f"{self.heading()}<p>{self.prose(1, 2)}</p><button>{self.word()}</button>", f'{self.sentence()} <a href="/p">{self.words(1, 3)}</a>'])
        return a + body + b

    def block(self) -> str:
        k = self.r.random()
        if k < 0.60:
            return self.r.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", '<p class="lead">{}</p>', "<div>{}</div>", "{}<br><br>"]).format(self.prose(1, 60 if self.r.random() < 0.1 else 15))
        if k < 0.70:
            n = self.r.randint(2, 4)
            return f"<h{n}>{self.words(1, 8)}</h{n}><p>{self.prose()}</p>"
        if k < 0.78:
            tag = self.r.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{self.sentence()}</li>" for _ in range(self.r.randint(2, 6))) + f"</{tag}>"
        if k < 0.83:
            return f"<blockquote><p>{self.prose(1, 4)}</p></blockquote>"
        if k < 0.88:
            return "<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.sentence()}</td></tr>" for _ in range(self.r.randint(2, 5))) + "</table>"
        if k < 0.92:
            return f'<figure><img src="x.png"><figcaption>{self.sentence()}</figcaption></figure>'
        if k < 0.96:
            return f"<section><h2>{self.words(1, 6)}</h2><p>{self.prose()}</p><p>{self.prose()}</p></section>"
        return f"<pre>{self.words(3, 40)}</pre>"

    def article(self, bare: bool = False) -> str:
        a, b = self.open(ARTICLE, 1) if not bare else ("", "")
        title = f"<h1>{self.words(1, 12)}</h1>"
        if self.r.random() < 0.15:
            title = f"<header>{title}</header>"
        out = [title] if self.r.random() < 0.85 else []
        for _ in range(int(14 ** self.r.random())):
            out.append(self.block())
            if self.r.random() < 0.06:
                out.append(self.around(self.r.choice(["advert", "sidebar", "notice", "form"])))
        if self.r.random() < 0.15:
            out.append(self.around(self.r.choice(["comments", "sidebar", "footer"])))
        return ("<table><tr>" if a.startswith("<td") else "") + a + "".join(out) + b + ("</tr></table>" if a.startswith("<td") else "")

    def page(self) -> str:
        alone = self.r.random() < 0.08
        bare = self.r.random() < (0.6 if alone else 0.08)
        before = [self.around(k) for k in ("header", "menu", "notice", "advert", "sidebar", "form") if self.r.random() < 0.5]
        after = [self.around(k) for k in ("comments", "sidebar", "notice", "advert", "form", "menu") if self.r.random() < 0.4]
        self.r.shuffle(before)
        self.r.shuffle(after)
        if self.r.random() < 0.85:
            after.append(self.around("footer"))
        if alone:
            before, after = [], []
        body = "".join([*before, self.article(bare), *after])
        if bare:  # main text stands right in the body
            if alone and self.r.random() < 0.5:
                return f'<body {MARK}="1">{self.prose() if self.r.random() < 0.5 else body}'
            return f'<!DOCTYPE html><html><head><title>{self.words(1, 9)}</title></head><body {MARK}="1">{body}</body></html>'
        if self.r.random() < 0.4:
            a, b = self.open(("div:class=container wrapper page row layout outer", "div:id=page wrapper container", "div:", "section:"), None)
            body = a + body + b
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 9)}</title><style>p{{}}</style></head><body>{body}" + ("</body></html>" if self.r.random() < 0.9 else "")


def pages(n: int = 1000, seed: int = 0) -> list[str]:
    make = Maker(seed)
    return [make.page() for _ in range(n)]
