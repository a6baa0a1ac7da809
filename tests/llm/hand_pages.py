"""Pages written by hand, of structures that the page maker doesn't have, with their main text as blocks."""

NEWS = (
    """<!doctype html><html lang=en><head><title>Bridge reopens - The Harbour Post</title><meta charset=utf-8><script>var x = "<p>no</p>";</script></head><body class="home page">
<div id="top-bar"><a href="/login">Sign in</a> <a href="/subscribe">Subscribe</a></div>
<header class="site-header"><a class=logo href="/">The Harbour Post</a><nav><ul><li><a href="/a">Politics</a><li><a href="/b">Sport</a><li><a href="/c">Culture</a></ul></nav></header>
<div class="cookie-banner" role=dialog><p>We use cookies to improve your experience.</p><button>Accept all</button></div>
<main><article class="story"><h1>Old bridge reopens after two years of repair</h1>
<p>The stone bridge over the river Aller was opened to walkers on Tuesday morning, two years after a flood had damaged three of its arches.</p>
<p>"We had to replace more than four hundred stones," said the engineer in charge, who has worked on the <a href="/x">river crossings</a> since 1998.
<div class="ad-slot advert"><p>Save 20% on new tyres today!</p></div>
<h2>What it cost</h2>
<p>The work cost 3.2&nbsp;million, a little less than planned &mdash; mostly because the winter was mild.</p>
<blockquote><p>It is the bridge I crossed to go to school.</p></blockquote>
</article></main>
<aside class="sidebar"><h3>Most read</h3><ol><li><a href="/1">Mayor resigns</a></li><li><a href="/2">Rain until Sunday</a></li></ol></aside>
<section id="comments" class="comments"><h3>2 comments</h3><div class="comment"><p>Great news, well done!</p></div><div class="comment"><p>Too expensive if you ask me.</p></div></section>
<footer><p>&copy; 2020 The Harbour Post. All rights reserved.</p><a href="/privacy">Privacy</a></footer></body></html>""",
    [
        "Old bridge reopens after two years of repair",
        "The stone bridge over the river Aller was opened to walkers on Tuesday morning, two years after a flood had damaged three of its arches.",
        '"We had to replace more than four hundred stones," said the engineer in charge, who has worked on the river crossings since 1998.',
        "What it cost",
        "The work cost 3.2 million, a little less than planned — mostly because the winter was mild.",
        "It is the bridge I crossed to go to school.",
    ],
)
BLOG = (
    """<html><body><div class="wrap"><div class="masthead"><p>notes from the workshop</p></div><div class="menu"><ul><li><a href=/>Home</a></li><li><a href=/about>About</a></li></ul></div>
<div class="post entry-content"><h1>How I sharpen a plane iron</h1><p>There are many ways; this one needs <b>three stones</b> and ten minutes.</p>
<ul><li>Flatten the back first.</li><li>Hold the bevel at thirty degrees.</li><li>Strop it on leather.</li></ul>
<p title=don't>If the edge shaves hair from your arm<br>it is sharp enough.</p><pre>angle = 30</pre>
<div class="share social"><ul><li><a href=/t>Tweet</a></li><li><a href=/f>Share</a></li></ul></div></div>
<div class="comment-list responses"><h3>Responses</h3><div class="comment-body"><p>I use a guide, it's quicker.</p></div></div>
<form class="newsletter"><label>Your mail</label><input type=text><button>Sign up</button></form>
<div class="footer"><p>Powered by coffee</p></div></div></body></html>""",
    [
        "How I sharpen a plane iron", "There are many ways; this one needs three stones and ten minutes.", "Flatten the back first.", "Hold the bevel at thirty degrees.", "Strop it on leather.",
        "If the edge shaves hair from your arm it is sharp enough.", "angle = 30",
    ],
)
MANUAL = (
    """<html><head><style>p{color:red}</style></head><body><nav class="breadcrumbs"><a href=/>Docs</a> » <a href=/cli>Command line</a></nav>
<aside class="nav rail"><ul><li><a href=/1>Install</a></li><li><a href=/2>Configure</a></li><li><a href=/3>Upgrade</a></li></ul></aside>
<article><header><h1>Command line options</h1></header><p>Every option can be given more than once; the last one counts.</p>
<table><tr><th>Option</th><th>Meaning</th></tr><tr><td>-v</td><td>Print more.</td></tr></table>
<section><h2>Exit codes</h2><p>Zero means that all went well.</p></section></article>
<footer class="site-footer"><ul><li><a href=/terms>Terms</a></li></ul></footer></body></html>""",
    ["Command line options", "Every option can be given more than once; the last one counts.", "Option", "Meaning", "-v", "Print more.", "Exit codes", "Zero means that all went well."],
)
RECIPE = (
    """<html><body><header><p class=logo>Kitchen</p></header><div id="content" class="main-content"><h1>Leek soup</h1><p>Serves four. Wash the leeks well &amp; cut them into rings.</p>
<div class="promo sponsored">Our pans are 10 &euro; cheaper this week</div><p>Let the butter melt, add the leeks and wait until they are soft.</p><p>Season with salt, pepper and a little nutmeg.</p>
<section class="related"><h3>You may also like</h3><ul><li><a href=/p>Potato soup</a></li></ul></section></div><footer>&copy; Kitchen</footer></body></html>""",
    ["Leek soup", "Serves four. Wash the leeks well & cut them into rings.", "Let the butter melt, add the leeks and wait until they are soft.", "Season with salt, pepper and a little nutmeg."],
)

PAGES = {"news": NEWS, "blog": BLOG, "manual": MANUAL, "recipe": RECIPE}
