"""Labelled pages for the block labeller: made from page forms by a fixed seed.

Every page is a tree of parts; the texts of kept parts begin with KEEP, a mark
that is taken off before anything reads the text.  Words are invented, so what
a block says rarely tells its class; some boilerplate carries usual phrases.
"""

from __future__ import annotations

import random

KEEP = "\ue000"
#: Usual phrases of parts that are not the article, and names of classes (fixed values).
PHRASES = {
    "nav": "Home|About|Contact|News|Sports|Products|Services|Blog|Shop|Help|Archive|Topics|Startseite|Kontakt|Accueil|Inicio",
    "notice": "We use cookies to improve your experience. Accept all|This site uses cookies|By continuing you agree to our terms|"
              "Breaking: service is limited today|Please enable JavaScript|You have 3 free articles left this month",
    "ad": "Advertisement|Sponsored|Buy now and save 20%|Limited offer, order today|Anzeige|Promoted content",
    "form": "Subscribe to our newsletter|Your email address|Sign up|Search|Log in|Password|Submit|Send",
    "footer": "All rights reserved|Privacy policy|Terms of use|Imprint|Copyright|Powered by|Follow us|Mentions légales|Impressum",
    "comment": "Great post!|I disagree with this|Reply|Thanks for sharing|posted 3 days ago|3 comments|Leave a comment|Anonymous says",
    "side": "Related articles|Most read|Popular posts|Recent posts|Categories|Tags|You may also like|Trending|About the author"}
NAMES = {
    "nav": "nav navbar menu navigation breadcrumb breadcrumbs main-menu top-nav tabs pagination topbar",
    "header": "header site-header masthead page-header branding banner logo top",
    "notice": "cookie cookie-banner notice alert banner consent message gdpr popup modal announcement",
    "ad": "ad ads advert advertisement sponsored promo banner-ad ad-slot sponsor adsbox",
    "form": "newsletter subscribe search login signup form-box search-form contact-form",
    "footer": "footer site-footer copyright bottom colophon legal page-footer",
    "comment": "comments comment-list discussion responses replies disqus comment respond",
    "side": "sidebar side related widget recommended popular more-stories rail secondary share social tags",
    "main": "content main article post entry entry-content article-body post-content story story-body text page-content body-text prose"}
SYLLABLES = "the an re in on er ti at en ou es or ed ing ha th nd st ea ly wh ion ble for to of le la de que une der die und ich sch el los as ra ció ña é ü".split()


class Pages:
    """Pages by a random generator."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def words(self, n: int) -> str:
        r = self.rng
        out = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n)]
        for k in range(0, n, r.randint(6, 14)):
            out[k] = out[k].capitalize()
            out[k - 1] += "."
        form = r.random()
        if form < 0.03:                                 # one word again and again
            out = [out[0]] * n
        elif form < 0.06:
            out = [w + r.choice(("%%%", "***", "$$$", "###", "&amp;&amp;")) for w in out]
        return " ".join(out)

    def phrase(self, kind: str) -> str:
        r = self.rng
        return r.choice(PHRASES[kind].split("|")) if r.random() < 0.4 else self.words(r.choice((1, 2, 4, 8, 15)))

    def box(self, kind: str, inner: str, tags: str) -> str:
        """``inner`` in an element that its tag or a name marks as of that kind."""
        r = self.rng
        tag = r.choice(tags.split())
        name = r.choice(NAMES[kind].split())
        plain = tag not in ("div", "section", "aside", "ul", "p", "td")
        if plain and r.random() < 0.5:
            out = f"<{tag}>{inner}</{tag}>"
        else:
            where = r.choice(("class", "class", "id"))
            extra = r.choice(("", "", " box", " w-100", " js"))
            out = f'<{tag} {where}="{name}{extra if where == "class" else ""}">{inner}</{tag}>'
        return f'<div class="wrap">{out}</div>' if r.random() < 0.15 else out

    def links(self, kind: str) -> str:
        r = self.rng
        items = [f'<a href="/{k}">{self.phrase(kind) if r.random() < 0.5 else self.words(r.randint(1, 2))}</a>' for k in range(r.randint(2, 8) if r.random() < 0.97 else 40)]
        form = r.random()
        if form < 0.75:
            return "<ul>" + "".join(f"<li>{i}</li>" if r.random() < 0.9 else f"<li>{i}" for i in items) + "</ul>"
        return "".join(f"<p>{i}</p>" for i in items) if form < 0.85 else " | ".join(items)

    def prose(self, kind: str) -> str:
        r = self.rng
        texts = [self.phrase(kind) if r.random() < 0.5 else self.words(r.choice((3, 8, 20, 40))) for _ in range(r.randint(1, 3))]
        return texts[0] if r.random() < 0.4 else "".join(r.choice(("<p>{}</p>", "<div>{}</div>", "<h3>{}</h3>", "<span>{}</span><br>")).format(t) for t in texts)

    def junk(self, kind: str) -> str:
        r = self.rng
        if kind == "nav":
            return self.box("nav", self.links("nav"), "nav nav nav div ul div")
        if kind == "header":
            inner = r.choice((f"<h1>{self.words(2)}</h1>", f"<div>{self.words(3)}</div>", f"<p>{self.words(5)}</p>")) + (self.junk("nav") if r.random() < 0.5 else "")
            return self.box("header", inner, "header header div")
        if kind == "form":
            inner = f"<label>{self.phrase('form')}</label><input><button>{self.phrase('form')}</button>"
            if r.random() < 0.4:
                inner = f"<p>{self.phrase('form')}</p>" + inner
            return f"<form action='/s'>{inner}</form>" if r.random() < 0.7 else self.box("form", inner, "div section")
        if kind == "footer":
            inner = r.choice((f"&copy; {self.words(2)} &middot; {self.words(r.randint(2, 16))}", self.prose("footer"), self.links("footer")))
            return self.box("footer", inner, "footer footer footer div")
        if kind == "comment":
            one = lambda: r.choice(("<li>{}</li>", '<div class="comment">{}</div>', "<p>{}</p>", '<article class="comment">{}</article>')).format(
                f"<p>{self.phrase('comment')}</p>" + f"<p>{self.words(r.choice((5, 15, 40)))}</p>")
            inner = (f"<h3>{self.phrase('comment')}</h3>" if r.random() < 0.6 else "") + "".join(one() for _ in range(r.randint(1, 5) if r.random() < 0.95 else 40))
            if r.random() < 0.3:
                inner += self.junk("form")
            return self.box("comment", f"<ol>{inner}</ol>" if r.random() < 0.2 else inner, "section div div")
        if kind == "side":
            inner = "".join(f"<h3>{self.phrase('side')}</h3>" + r.choice((self.links("side"), self.prose("side"))) for _ in range(r.randint(1, 3)))
            return self.box("side", inner, "aside aside div section")
        if kind == "ad":
            return self.box("ad", self.prose("ad"), "div div aside section ins p")
        return self.box("notice", self.prose("notice"), "div div section aside p")

    def kept(self, n: int) -> str:
        return KEEP + self.words(max(1, n))

    def body(self) -> str:
        r = self.rng
        out = []
        if r.random() < 0.85:
            head = f"<h1>{self.kept(r.randint(2, 12))}</h1>"
            if r.random() < 0.15:
                head += f"<h2>{self.kept(r.randint(4, 15))}</h2>"
            out.append(f"<header>{head}</header>" if r.random() < 0.12 else head)
        for _ in range(r.choice((0, 1, 2, 3, 5, 8, 14) if r.random() < 0.97 else (40, 80))):
            form, n = r.random(), r.choice((1, 2, 5, 12, 30, 60, 100))
            if r.random() < 0.015:                      # the same paragraph many times
                out += [f"<p>{self.kept(r.choice((1, 2, 4)))}</p>"] * r.choice((6, 30, 120))
            if form < 0.70:
                text = self.kept(n)
                if r.random() < 0.2:
                    text = text.replace(" ", r.choice((" <b>", " <em>", ' <a href="/x">')), 1)
                    text += r.choice(("</b>", "</em>", "</a>", "<br>")) if r.random() < 0.8 else ""
                out.append(f"<p>{text}</p>" if r.random() < 0.85 else f"<p>{text}")
            elif form < 0.78:
                out.append(f"<h{r.randint(2, 4)}>{self.kept(r.randint(1, 8))}</h2>")
            elif form < 0.85:
                out.append("<ul>" + "".join(f"<li>{self.kept(r.randint(1, 20))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif form < 0.89:
                out.append(f"<blockquote><p>{self.kept(n)}</p></blockquote>" if r.random() < 0.5 else f"<blockquote>{self.kept(n)}</blockquote>")
            elif form < 0.92:
                out.append("<table>" + "".join(f"<tr><td>{self.kept(1)}</td><td>{self.kept(3)}</td></tr>" for _ in range(r.randint(1, 3))) + "</table>")
            elif form < 0.95:
                out.append(f"<figure><img src=x><figcaption>{self.kept(r.randint(2, 9))}</figcaption></figure>")
            elif form < 0.97:
                out.append(f"<pre>{self.kept(r.randint(2, 20))}</pre>")
            else:
                out.append(f"<div>{self.kept(n)}</div>")
            if r.random() < 0.06:
                out.append(self.junk(r.choice(("ad", "form", "side", "notice"))))
        return "".join(out) or f"<p>{self.kept(8)}</p>"

    def page(self) -> str:
        r = self.rng
        body = self.body()
        form = r.random()
        name = r.choice(NAMES["main"].split())
        if r.random() < 0.08:
            body += self.junk("comment")
        if r.random() < 0.06:
            body += self.box("footer", self.prose("footer"), "footer")
        if form < 0.45:
            main = f"<article>{body}</article>" if r.random() < 0.6 else f'<article class="{name}">{body}</article>'
            if r.random() < 0.3:
                main = r.choice(("<main>{}</main>", '<div id="content">{}</div>', '<main><div class="container">{}</div></main>')).format(main)
        elif form < 0.6:
            main = f"<main>{body}</main>"
        elif form < 0.9:
            main = f'<div {r.choice(("class", "id"))}="{name}">{body}</div>'
        else:
            main = f'<section class="{name}">{body}</section>'
        before = [k for k, p in (("header", 0.4), ("notice", 0.25), ("nav", 0.7), ("ad", 0.45), ("form", 0.2)) if r.random() < p]
        after = [k for k, p in (("comment", 0.3), ("side", 0.4), ("ad", 0.2), ("form", 0.15), ("nav", 0.1), ("notice", 0.1)) if r.random() < p]
        if r.random() < 0.2:
            r.shuffle(before)
        if r.random() < 0.2:
            before.append("side")
        r.shuffle(after)
        if r.random() < 0.75:
            after.append("footer")
        page = "".join(self.junk(k) for k in before) + main + "".join(self.junk(k) for k in after)
        if r.random() < 0.15:
            page = f'<div class="{r.choice(("page", "container", "wrapper", "site"))}">{page}</div>'
        return f"<html><head><title>{self.words(4)}</title></head><body>{page}" + ("</body></html>" if r.random() < 0.8 else "")
