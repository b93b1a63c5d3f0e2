"""Inputs derived from the given tables.

The stored pages hold no images, ids, noscripts or deep link graphs, so those inputs are
built from whole tables by expressions that mean the same in Spark SQL and in DuckDB.
"""

from __future__ import annotations

from pageloom.profile import DOMAINS

BARE, HOST = DOMAINS
SITE = f"https://{HOST}"
SEED = f"{SITE}/1000-stack-questions-answers/"
CLASSIFY_SEED = f"{SITE}/1000-data-structure-questions-answers/"

ESCAPED_TEXT = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"

# One link per document, of every kind the classifier tells apart.
CANDIDATE = f"""CASE doc_id % 16
  WHEN 0 THEN '{SITE}/data-structure-questions-answers-' || doc_id || '/'
  WHEN 1 THEN 'http://{BARE}/data-structure-mcq-' || doc_id || '?utm=1#x'
  WHEN 2 THEN '{SITE}/data-structures-algorithms/' || doc_id
  WHEN 3 THEN '{SITE}/java-questions-answers-' || doc_id
  WHEN 4 THEN '{SITE}/best-reference-books-data-structures/' || doc_id
  WHEN 5 THEN '{SITE}/BEST-REFERENCE-BOOKS-data-structure-mcqs-' || doc_id
  WHEN 6 THEN '{SITE}/data-structure-questions-answers-feedback/' || doc_id
  WHEN 7 THEN '{SITE}/data-structure-questions-answers-' || doc_id || '/?utm_source=feed'
  WHEN 8 THEN '{SITE}/about-data-structure-questions-answers-' || doc_id
  WHEN 9 THEN 'https://{BARE}/1000-data-structure-questions-answers?x=' || doc_id
  WHEN 10 THEN 'https://evil.example.com/data-structure-questions-answers-' || doc_id
  WHEN 11 THEN 'mailto:' || doc_id || '@{BARE}'
  WHEN 12 THEN '{SITE}/1000-physics-data-structure-questions-answers-' || doc_id
  WHEN 13 THEN 'HTTPS://{HOST.upper()}/DATA-OBJECTIVE-QUESTIONS-' || doc_id || ';p=1'
  WHEN 14 THEN '{SITE}/structure-multiple-choice/' || lang || '/' || source
  ELSE '{SITE}:80/data-structure-questions-answers-' || doc_id END"""

LISTING_URL = f"""'{SITE}/' || CASE doc_id % 3 WHEN 0 THEN doc_id || '-' WHEN 1 THEN '' ELSE '//' END
  || upper(lang) || '--' || source || '-x/y' || CASE doc_id % 5
  WHEN 0 THEN '-questions-answers/' WHEN 1 THEN '-mcq-multiple-choice-questions'
  WHEN 2 THEN '-interview-questions/?q=1' WHEN 3 THEN '-objective-questions' ELSE '-interview-questions-answers-2' END"""

# Every kind of href, on a page whose own path must not matter.
HREF = """CASE doc_id % 18
  WHEN 0 THEN source || '/' || doc_id
  WHEN 1 THEN '/a b/' || doc_id
  WHEN 2 THEN '../' || doc_id
  WHEN 3 THEN './x/../' || doc_id || '/.'
  WHEN 4 THEN '//o.example.com/' || doc_id
  WHEN 5 THEN '?q=' || doc_id
  WHEN 6 THEN 'mailto:a@b'
  WHEN 7 THEN '#' || doc_id
  WHEN 8 THEN '   '
  WHEN 9 THEN '/a/./b/../' || doc_id || '/..'
  WHEN 10 THEN ' c//d//' || doc_id || '/ '
  WHEN 11 THEN 'http://other.example.org/x/../' || doc_id
  WHEN 12 THEN 'HTTPS://Other.example.org/' || doc_id || '?'
  WHEN 13 THEN '/p;v=' || doc_id || '?a=1#b'
  WHEN 14 THEN 'https:' || doc_id
  WHEN 15 THEN '/q#'
  WHEN 16 THEN '../../' || source || '/./'
  ELSE 'javascript:void(0)' END"""
RESOLVED = """CASE doc_id % 18
  WHEN 0 THEN base || '/' || source || '/' || doc_id
  WHEN 1 THEN base || '/a b/' || doc_id
  WHEN 2 THEN base || '/' || doc_id
  WHEN 3 THEN base || '/' || doc_id || '/'
  WHEN 4 THEN 'https://o.example.com/' || doc_id
  WHEN 5 THEN base || '?q=' || doc_id
  WHEN 6 THEN 'mailto:a@b'
  WHEN 9 THEN base || '/a/'
  WHEN 10 THEN base || '/c/d/' || doc_id || '/'
  WHEN 11 THEN 'http://other.example.org/x/../' || doc_id
  WHEN 12 THEN 'https://Other.example.org/' || doc_id
  WHEN 13 THEN base || '/p;v=' || doc_id || '?a=1#b'
  WHEN 14 THEN base || '/' || doc_id
  WHEN 15 THEN base || '/q'
  WHEN 16 THEN base || '/' || source || '/'
  WHEN 17 THEN 'javascript:void(0)' END"""

# A page whose links sit in one of the content containers, with decoys before and after.
ROOTED_HTML = """'<html><body><nav><a href="/decoy">d</a></nav>' || CASE doc_id % 7
  WHEN 0 THEN '<article>' || inner_html || '<div class="wide entry-content"><a href="/deep">z</a></div></article>'
  WHEN 1 THEN '<main><div class="inside-article">' || inner_html || '</div></main>'
  WHEN 2 THEN '<article>' || inner_html || '</article><article><a href="/second">z</a></article>'
  WHEN 3 THEN '<div id="content">' || inner_html || '</div>'
  WHEN 4 THEN '<main>' || inner_html || '</main>'
  WHEN 5 THEN '<section>' || inner_html || '</section>'
  ELSE '<div id="content">' || inner_html || '<article><a href="/inner">z</a></article></div>' END
  || '<a href="/after">d</a></body></html>'"""
INNER_HTML = """'<p><a href="/l' || doc_id || '">a</a><A HREF=/m' || doc_id || '>b</A><a name=x>c</a><a href="#t">d</a></p>'"""

# Every removal rule once or twice, around the text of a document.
DIRTY_HTML = f"""'<html><head><title>' || source || '</title></head><body><div class="entry-content x" id="root">'
  || '<h1 class="t">' || source || '</h1><p style="s">' || {ESCAPED_TEXT} || '</p>'
  || CASE doc_id % 8
  WHEN 0 THEN '<p>See <a href="/x">more</a></p><p><b><a href="/y">l</a></b> tail</p>'
  WHEN 1 THEN '<p>To practice <b>x</b> now</p><p><b>To practice ' || doc_id || '</b></p>'
  WHEN 2 THEN '<div class="y sf-mobile-ads"><p>ad</p></div><div id="comments">c</div><div id="comments2">u</div>'
  WHEN 3 THEN '<p> </p><div><br></div><p>a<br>b</p><p>&nbsp;</p>'
  WHEN 4 THEN '<table class="t"><tr><td style="y" align=l>' || doc_id || '</td></tr></table><form>f</form><iframe>i</iframe>'
  WHEN 5 THEN '<noscript>n</noscript><p>advertisement</p><p>Advertisement</p><!--To practice--><!--c-->'
  WHEN 6 THEN '<ul><li>one<li>two <a href=z>z</a></ul><img class="advertisement" src="/i.png"><script>s</script>'
  ELSE '<div>Next steps<i>k</i></div><div><span><i> </i></span></div>Participate in ' || doc_id END
  || '</div><p>outside</p></body></html>'"""
CLEANED_HTML = f"""'<div><h1>' || source || '</h1><p>' || {ESCAPED_TEXT} || '</p>' || CASE doc_id % 8
  WHEN 0 THEN '<p> tail</p>'
  WHEN 1 THEN '<p><b>x</b> now</p>'
  WHEN 2 THEN '<div>u</div>'
  WHEN 3 THEN '<p>a<br/>b</p>'
  WHEN 4 THEN '<table class="t"><tr><td style="y" align="l">' || doc_id || '</td></tr></table>'
  WHEN 5 THEN '<p>Advertisement</p><!--c-->'
  WHEN 6 THEN '<ul><li>one</li></ul><img class="advertisement" src="/i.png"/>'
  ELSE '<div><i>k</i></div>' END || '</div>'"""
CLEANED_TAIL = """CASE doc_id % 8 WHEN 0 THEN 'tail' WHEN 1 THEN 'xnow' WHEN 2 THEN 'u' WHEN 3 THEN 'ab'
  WHEN 4 THEN '' || doc_id WHEN 5 THEN 'Advertisement' WHEN 6 THEN 'one' ELSE 'k' END"""

# Stored images: one per document. A third of all pages show image 5.
IMAGE_HOST = "http://img.example.com/"
IMAGE_LIMIT = 4096
# Files of images: folder, name and ending; what an ending means, one of them no type that is accepted.
IMAGE_FILE = """(doc_id % 64) || '/' || doc_id || '.' || CASE doc_id % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'JPG' WHEN 2 THEN 'svg' ELSE 'webp' END"""
FILE_TYPES = {"png": "image/png", "jpg": "image/jpeg", "svg": "image/svg+xml", "webp": "image/webp"}
IMAGE_TYPE = """CASE doc_id % 5 WHEN 0 THEN 'image/png' WHEN 1 THEN 'IMAGE/JPEG; charset=x'
  WHEN 2 THEN 'image/svg+xml' WHEN 3 THEN 'image/gif' ELSE 'text/html' END"""
FIRST_IMAGE = f"'{IMAGE_HOST}' || (doc_id - doc_id % 7)"
SECOND_IMAGE = f"'{IMAGE_HOST}' || CASE WHEN doc_id % 3 = 0 THEN 5 ELSE doc_id + 1 END"
IMAGE_HTML = f"""'<article><p>t<img src="' || {FIRST_IMAGE} || '" alt="q"></p>'
  || '<img class="lazyload" data-src="' || {SECOND_IMAGE} || '"><noscript><img data-src="' || {SECOND_IMAGE}
  || '" src="x.gif"></noscript><p><img src="/local.png"></p><div><img src="{IMAGE_HOST}none"></div></article>'"""

# Pages with something wrong, by page_id.
BROKEN_HTML = """CASE page_id % 10 WHEN 1 THEN NULL WHEN 2 THEN replace(html, '<title>', '<title>Just a moment... ')
  WHEN 3 THEN '' WHEN 4 THEN replace(html, '<title>', '<title>just a moment ') ELSE html END"""
MATH_HTML = """CASE page_id % 4 WHEN 0 THEN replace(html, '<style>', '<script src="https://c/libs/mathjax/2.7.7/MathJax.js"></script><style>')
  WHEN 1 THEN replace(html, '<style>', '<script src="/MathJax.js"></script><style>')
  WHEN 2 THEN replace(html, '</body>', '<script async src=/mathjax.js></script></body>') ELSE html END"""

# What somebody types: a stored address, the same with a fragment, or one that differs in its query only.
TYPED_URL = """CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN url || '#sec' ELSE url || '?id=' || page_id END"""
# The tries to get page i of the derived site.
OUTCOMES = """CASE doc_id % 7 WHEN 3 THEN array('error', 'error', 'error', 'ok') WHEN 2 THEN array('rejected', 'ok')
  WHEN 1 THEN array('error', 'error', 'ok') ELSE array('ok') END"""
# Ids that do not follow the URLs: an odd factor takes the numbers below 2^32 to each other.
SHUFFLED_ID = "page_id * 2654435761 % 4294967296"
# Three versions of a page: missing, a challenge, empty or as it is.
VERSION_HTML = """CASE (page_id + v) % 4 WHEN 0 THEN NULL WHEN 1 THEN replace(html, '<title>', '<title>Just a moment... ')
  WHEN 2 THEN '' ELSE html END"""
