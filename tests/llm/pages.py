"""Pages written by hand, unlike the generator's: shapes of sites, each in several kinds of markup, with their main blocks."""

# Each shape: a list of (kind, tag, text) in page order; kind "main" is the article, others name what stands around it.
SHAPES = {
    "news": [
        ("nav", "a", "World"), ("nav", "a", "Politics"), ("nav", "a", "Sport"),
        ("main", "h1", "Council votes to rebuild the old bridge"),
        ("main", "p", "The town council voted on Monday evening to rebuild the bridge that was closed after the spring floods."),
        ("main", "p", "Engineers said the work would take about two years. Residents will have to use the northern crossing until then."),
        ("main", "p", "\"We have waited long enough,\" said one member of the council, who had asked for a vote in March."),
        ("footer", "p", "© 2024 The Valley Paper. All rights reserved."),
    ],
    "blog": [
        ("header", "p", "My kitchen notes"), ("nav", "a", "Home"), ("nav", "a", "About"),
        ("main", "h2", "Bread without kneading"),
        ("main", "p", "Mix the flour, the water and the salt in the evening, cover the bowl and leave it on the table overnight."),
        ("main", "p", "In the morning the dough will be full of bubbles. Fold it twice, let it rest and heat the oven."),
        ("main", "li", "Four cups of flour, not too fine."), ("main", "li", "Two cups of cold water."),
        ("comments", "p", "Great recipe, mine came out a little dry!"), ("comments", "p", "Thanks, I will try it on Sunday."),
        ("footer", "p", "Privacy policy"),
    ],
    "manual": [
        ("nav", "a", "Install"), ("nav", "a", "Configure"), ("nav", "a", "Upgrade"), ("nav", "a", "Troubleshooting"),
        ("main", "h1", "Configure the server"),
        ("main", "p", "The server reads its settings from a file in the home folder when it starts. Lines that begin with a hash are ignored."),
        ("main", "h2", "Ports"),
        ("main", "p", "By default it listens on two ports. Change them if another program on the same machine already uses them."),
        ("main", "p", "Restart the server after each change, or the old settings stay in force until the next boot."),
        ("footer", "p", "Back to top"),
    ],
    "encyclopedia": [
        ("header", "a", "Log in"),
        ("main", "h1", "Lighthouse"),
        ("main", "p", "A lighthouse is a tower that gives out light from a system of lamps and lenses and serves as a beacon for ships at sea."),
        ("main", "p", "Towers mark dangerous coasts, reefs and safe entries to harbours. Their number has fallen since other aids became cheaper."),
        ("main", "h2", "History"),
        ("main", "p", "Before harbours had clear limits, sailors were guided by fires that were built on the tops of hills."),
        ("footer", "p", "Terms of use"), ("footer", "p", "About us"),
    ],
    "story": [
        ("main", "p", "It was late when the train stopped between two fields, and nobody in the carriage could say why."),
        ("main", "p", "The old man put down his book. He had seen this happen once before, many years ago, in another country."),
        ("main", "p", "Outside a lamp was moving along the rails. It came nearer, stood still for a moment and then went out."),
        ("footer", "p", "Copyright 2024"),
    ],
    "press": [
        ("nav", "a", "Products"), ("nav", "a", "Company"), ("nav", "a", "Contact us"), ("notice", "p", "We use cookies to improve your experience."),
        ("main", "h1", "New plant opens in the north"),
        ("main", "p", "The company opened its fourth plant today. About three hundred people will work there by the end of the year."),
        ("main", "p", "The plant makes parts for pumps that are used in farming and in small towns without a water network."),
        ("share", "a", "Share this"), ("form", "label", "Subscribe to our newsletter"),
        ("footer", "p", "All rights reserved."),
    ],
    "german": [
        ("nav", "a", "Startseite"), ("nav", "a", "Kontakt"),
        ("main", "h1", "Der Markt zieht um"),
        ("main", "p", "Der Wochenmarkt zieht im Mai auf den Platz vor dem alten Bahnhof, weil die Straße am Rathaus erneuert wird."),
        ("main", "p", "Die Händler sind zufrieden. Dort gibt es mehr Schatten, und die Busse halten gleich nebenan."),
        ("footer", "p", "Impressum"), ("footer", "p", "Datenschutz"),
    ],
    "spanish": [
        ("nav", "a", "Inicio"), ("nav", "a", "Noticias"), ("ad", "p", "Publicidad"),
        ("main", "h2", "El museo abre de noche"),
        ("main", "p", "El museo abrirá sus puertas hasta las once de la noche todos los viernes del verano, y la entrada será libre."),
        ("main", "p", "La directora espera que vengan más jóvenes. También habrá música en el patio y visitas con guía."),
        ("footer", "p", "Aviso legal"),
    ],
}
NAMES = {"nav": "menu", "header": "header", "footer": "footer", "comments": "comments", "notice": "cookie-notice", "share": "share", "form": "newsletter", "ad": "advertisement", "main": "article-body"}
TAGS = {"nav": "nav", "header": "header", "footer": "footer", "comments": "section", "notice": "div", "share": "div", "form": "form", "ad": "aside", "main": "article"}


def _runs(shape):
    runs = []
    for kind, tag, text in shape:
        if not runs or runs[-1][0] != kind:
            runs.append((kind, []))
        runs[-1][1].append((tag, text))
    return runs


def _inside(tag, text, style):
    text = text.replace("&", "&amp;")
    if style == "loose":
        return {"a": f"<A HREF=/x>{text}</A> |\n", "li": f"<LI>{text}\n", "p": f"<P>{text}\n"}.get(tag, f"<{tag.upper()}>{text}</{tag.upper()}>\n")
    if style == "nameless" and tag in ("p", "h1", "h2", "li"):
        return f'<div class="t{len(text) % 7}">{text}</div>'
    return f'<a href="/{len(text)}">{text}</a>' if tag == "a" else f"<{tag}>{text}</{tag}>"


def _page(shape, style):
    parts = []
    for k, (kind, blocks) in enumerate(_runs(shape)):
        inside = "".join(_inside(t, x, style) for t, x in blocks)
        if style == "semantic":
            name = f' class="{NAMES[kind]}"' if TAGS[kind] in ("div", "section", "aside") else ""
            parts.append(f"<{TAGS[kind]}{name}>{inside}</{TAGS[kind]}>")
        elif style == "nameless":
            parts.append(f'<div class="c{k}">{inside}</div>')
        else:
            parts.append(f'<div id="{NAMES[kind]}">{inside}</div>')
    if style == "loose":
        return "<HTML><HEAD><TITLE>A page</TITLE><BODY BGCOLOR=white>" + "".join(parts)
    return f"<!doctype html><html><head><title>A page</title></head><body>{''.join(parts)}</body></html>"


STYLES = ["semantic", "named", "nameless", "loose"]
PAGES = [(f"{name}, {style}", _page(shape, style), [text for kind, _, text in shape if kind == "main"]) for name, shape in SHAPES.items() for style in STYLES]
