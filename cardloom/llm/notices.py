"""A small labelled table of notices and ordinary lines, and the model of notices that is fitted on it.

The rows are written by hand: messages as common servers, browsers, frameworks and page builders show them by default,
and lines that pages have anyway, also lines that speak of errors. A template is judged by logistic regression over
words, word pairs and the letters inside words, so that what is learnt carries over to messages that the table lacks.
Lines of the corpus are added as ordinary ones: next to all of them are.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache
from http import HTTPStatus

import numpy as np

#: Bits for the number of a word; at most so many words are kept, and so many more judged at once, which fit into them. Lines longer than LONG are judged alone.
WORD_BITS, MOST_WORDS, AT_ONCE, LONG = 20, 200_000, 300_000, 100_000
EPOCHS, RATE, DECAY = 200, 0.5, 1e-6

# Labelled rows, one a line: what is shown in place of content.
_SHOWN = """
The requested URL was not found on this server.
The page you are looking for might have been removed, had its name changed, or is temporarily unavailable.
This page isn't available right now. The link may be broken.
Sorry, the page you were looking for doesn't exist.
Oops! That page can't be found. It may have moved.
We couldn't find that page. The article has gone missing.
Oops, something broke.
You don't have permission to access this resource.
Access denied
Access to this page has been denied.
You are not allowed to view this content. Please sign in.
The server encountered an internal error and was unable to complete your request.
The server is temporarily unable to service your request due to maintenance downtime or capacity problems.
Service unavailable. Please try again later.
Briefly unavailable for scheduled maintenance. Check back in a minute.
Something went wrong. Try again in a moment.
An unexpected error occurred on our end. Please reload the page.
Error establishing a database connection
no healthy upstream
upstream request timeout, connection reset
The connection was reset while the headers were loading.
Checking if the site connection is secure
Please wait while we check your browser. This may take a few seconds.
Verify you are human to continue.
One moment, please...
Just a second...
Loading...
Enable JavaScript and cookies to continue
You need to enable JavaScript to run this app.
JavaScript is turned off in your browser. Please switch it on to use this website.
This application requires scripts. Your browser does not run them.
Your session has timed out. Please log in again.
This account is suspended. Contact your hosting provider.
Rate limit exceeded. Too many attempts: wait and retry after 0 seconds.
Application error: an exception has occurred while loading (see the browser console for more information).
Fatal error: Allowed memory size of 0 bytes exhausted in /var/www/html/index.php on line 0
Warning: Undefined array key in /var/www/html/index.php on line 0
Notice: Undefined variable $x in template.php on line 0
Uncaught TypeError: Cannot read properties of undefined
Traceback (most recent call last): exception
Index of / Parent Directory Name Last modified Size Description
Untitled
Untitled page
New page
Sample page
Example text, replace it
Placeholder text
This is sample text. Replace this with your own content.
Add a description here
Enter a title
Insert your text here
Your title here
Heading goes here
Write a short introduction to this page here
Click here to edit. Double click this block to add your own text.
This page is under construction
Under construction
Coming soon
TODO: add content
TBD
to be determined
dummy
dummy text
foo bar
asdf
qwerty
test
test test
xxx
blah blah
text text text
null
undefined
NaN
Seite nicht gefunden. Die aufgerufene Seite existiert nicht.
Die Seite konnte nicht gefunden werden.
Zugriff verweigert
Sie haben keine Berechtigung. Zugriff gesperrt.
Ein unerwarteter Fehler ist aufgetreten. Bitte laden Sie die Seite neu.
Fehler 0: Bitte versuchen Sie es noch einmal.
Der Dienst ist wegen Wartungsarbeiten vorübergehend nicht verfügbar.
Bitte schalten Sie JavaScript im Browser ein, um fortzufahren.
Diese Website benötigt JavaScript und kann ohne Skripte nicht angezeigt werden.
Die Anwendung läuft in Ihrem Browser nicht.
Ihre Sitzung ist abgelaufen. Bitte melden Sie sich erneut an.
Platzhalter
Platzhaltertext hier ersetzen
Beispieltext
Geben Sie hier Ihren Text ein
Überschrift hier eingeben
Ihr Titel steht hier
Ohne Titel
Unbenannte Seite ohne Titel
Page introuvable
La page que vous cherchez n'existe pas.
La page est introuvable.
Accès refusé
Vous n'êtes pas autorisé : droits insuffisants.
Une erreur s'est produite. Veuillez réessayer ultérieurement.
Une erreur inattendue est survenue.
Service temporairement indisponible pour maintenance.
Veuillez activer JavaScript dans votre navigateur pour continuer.
Ce site ne peut pas s'afficher sans JavaScript, les scripts sont désactivés.
Cette application ne fonctionne pas sans scripts.
Votre session a expiré, veuillez vous reconnecter.
Saisissez votre texte ici
Ajoutez un titre ici
Exemple de texte à remplacer
Sans titre
Page sans nom
Página no encontrada. La página que busca no existe.
No se encontró la página solicitada.
Acceso denegado
No tiene permiso para acceder.
Ha ocurrido un error. Vuelva a intentarlo más tarde.
Se produjo un error inesperado, inténtelo otra vez.
Servicio no disponible por mantenimiento.
Active JavaScript en su navegador para ver el sitio.
Esta aplicación necesita scripts y no funciona si están desactivados.
Su sesión ha caducado.
Escriba su texto aquí
Añada un título aquí
Texto de ejemplo para sustituir
Sin título
Página nueva sin título
Página não encontrada. A página que procura não existe.
Não foi possível encontrar a página pedida.
Acesso negado
Não tem permissão para aceder.
Ocorreu um erro
Tente de novo mais tarde.
Serviço indisponível para manutenção.
Ative o JavaScript no seu navegador para continuar a ver a página.
Esta aplicação precisa de scripts e não funciona sem eles.
A sua sessão expirou.
Escreva o seu texto aqui
Insira um título aqui
Texto de exemplo, a substituir
Sem título
Página nova sem título
페이지를 찾을 수 없습니다.
요청한 페이지가 존재하지 않습니다.
접근이 거부되었습니다. 권한이 없습니다.
오류가 발생했습니다.
잠시 후 다시 시도하세요.
서비스를 이용할 수 없습니다. 점검 중입니다.
페이지를 보려면 브라우저에서 자바스크립트를 켜 주세요.
스크립트가 꺼져 있습니다. 자바스크립트를 활성화해 주세요.
세션이 만료되었습니다. 다시 로그인해 주세요.
여기에 텍스트를 입력하세요
내용을 입력해 주세요
제목을 입력하세요
제목 없음
제목 없는 문서
ページが見つかりません。
お探しのページは存在しないか、見つかりませんでした。
アクセスが禁止されています。権限がないため拒否されました。
エラーが発生しました。
もう一度お試しください。
しばらくしてからお試しください。
サービスを利用できません。メンテナンス中です。
表示するにはブラウザのJavaScriptを有効にしてください。
スクリプトが無効になっています。
セッションの有効期限が切れました。
ここにテキストを入力
見出しを入力
本文を入力してください
無題
無題のドキュメント
"""

# Labelled rows, one a line: what pages have anyway, and sentences about such messages.
_ORDINARY = """
How to fix a 404 error on your site
Seven things to know about HTTP errors
What our error messages say about us
Writing for people who browse without scripts
Reading the web without JavaScript is still a pleasure
How visitors without JavaScript find a good page
Why error codes bore most people
A guide to placeholders in letters
The history of dummy text in printing
A song about a page that nobody found
The day the server failed and what we learnt
The locked room: a mystery in three parts
An exhibition of works without a title
The meaning of null in databases
An undefined border and its long story
The bridge is closed for maintenance in June.
Nobody was denied entry to the tower.
Loading the boats takes a whole morning.
The museum has been under repair since 0.
“Out of order” was written on every lift in town.
“Closed until further notice” became the name of a band in 0.
What “pending” means in a letter from the town hall
Why good signs say little
Designing better forms for a small office
Was Fehlermeldungen über uns verraten
Wie man einen Fehler auf der eigenen Seite findet
Ein Abend über die Seite, die es nicht gab
Ce que les messages d'erreur disent de nous
Comment expliquer une erreur à ses lecteurs
Lo que dicen de nosotros los mensajes de error
Cómo explicar un error a los lectores
O que as mensagens de erro dizem de nós
Como explicar um erro aos leitores
오류 메시지의 역사
독자에게 오류를 설명하는 법
エラーメッセージの歴史
読者に間違いを説明する方法
Share on social media
Share by mail
Save for later
Newsletter
Sign up to get our news every Friday.
We use cookies to improve your experience.
Manage cookie settings
By using this website you accept our terms.
More from this author
Recommended for you
Popular articles
Advertisement
About the company
Help | Jobs | Press | Contact
Your email address
Skip to main content
All comments
Tell us what you think.
Zum Seitenanfang
Weitere Artikel zum Thema
Diese Seite verwendet Cookies.
Mit dem Besuch dieser Seite akzeptieren Sie unsere Bedingungen.
Newsletter bestellen
Anzeige
Retour en haut de la page
Articles similaires
Ce site utilise des cookies pour mesurer l'audience.
En utilisant ce site, vous acceptez nos conditions.
S'abonner à la lettre
Publicité
Ir arriba
Artículos relacionados
Este sitio utiliza cookies propias.
Al usar este sitio acepta las condiciones.
Suscribirse al boletín
Publicidad
Ir para o topo
Artigos relacionados
Este site utiliza cookies.
Ao usar este site, aceita as condições.
Subscrever a newsletter
Publicidade
위로 가기
관련 기사
이 사이트는 쿠키를 사용합니다.
사이트를 이용하면 약관에 동의하게 됩니다.
뉴스레터 신청
광고
トップへ戻る
関連記事
このサイトはクッキーを使用しています。
サイトを利用すると規約に同意したことになります。
メールマガジン登録
広告
A walk through the old town
Five recipes for the winter
Ein Spaziergang durch die Altstadt
Une promenade dans la vieille ville
Un paseo por el casco antiguo
Um passeio pela cidade velha
옛 도시를 걷다
古い町を歩く
0.
No. 0
0 %
© 0 The Company
0) paper
0. paper, pens
0 | 0.00
0;0.00
* paper, pens
function(a,b){return a.push([0,"b"])}(window,[]);
var x = 0; if (x) { y(); }
aGVsbG8gd29ybGQgaG93IGFyZSB5b3U=
q0Zk/9xTQ+b3dVw1mPz
#%!&*^~<>|-=
asldkfj qwpeor zmxncb
"""

_WORD = re.compile(r"[^\W\d_]+|\d+|[$/_]+")
_QUOTED = re.compile(r"[“«„「\"][^”»“」\"]*[”»“」\"]")
_QUOTE = re.compile(r"[“«„「\"]")
_MARKS = re.compile("[“”«»「]")
_SIZES = [f"n{i}" for i in range(7)]
_ENDS = {c: "end" + c for c in ".!?…。"}
_EAST = re.compile(r"[぀-ヿ㐀-鿿가-힣]")


def shown() -> list[str]:
    """The labelled notices, with those of the status codes of HTTP made from their table."""
    out = _SHOWN.strip().split("\n")
    forms = ("0 {}", "HTTP error 0: {}", "Error 0 ({})", "HTTP/0.0 0 {}")
    for i, s in enumerate(s for s in HTTPStatus if s >= 400):
        out += [s.phrase, forms[i % len(forms)].format(s.phrase)]
    return [*out, "Error 0", "HTTP ERROR 0", "Oops! Error 0", "Fehler 0", "Erreur 0."]


def ordinary() -> list[str]:
    return _ORDINARY.strip().split("\n")


@lru_cache(maxsize=200_000)
def _word_features(w: str) -> tuple[str, ...]:
    """The word, and the letters inside it; runs of East Asian characters are what stands inside them."""
    if w.isdigit():
        return ("w0",)
    if _EAST.search(w):
        return ("w" + w, *[w[i : i + k] for k in (2, 3) for i in range(len(w) - k + 1)])
    return (f"w{w}", f"s{w[:5]}", f"s{w[:7]}") if len(w) > 5 else (f"w{w}",)


def words_of(line: str) -> list[str]:
    """The words, numbers and signs of a line in small letters."""
    return _WORD.findall(line)


def _looks(line: str, words: list[str]) -> tuple[list[str], tuple[str, ...]]:
    """The words of a line that speak for it, and what it looks like as a whole; what stands in quotation marks is spoken of and left out."""
    if _QUOTE.search(line) and len(bare := words_of(kept := _QUOTED.sub(" ", line))) >= 3:
        line, words = kept, bare
    n = len(words)
    return words, ("bias", _SIZES[min(n, 12) // 2], _ENDS.get(line[-1:], "end"), "same" if n > 1 and words[0] == words[-1] and len(set(words)) == 1 else "other", "ask" if "?" in line or "？" in line else "tell", "quote" if _MARKS.search(line) else "bare", "colon" if ": " in line else "flow")


def _pairs(words: list[str]) -> set[tuple[str, str]]:
    plain = ["0" if w.isdigit() else w for w in words]
    return set(zip(["^", *plain], [*plain, "$"]))


def features(line: str) -> list:
    """The features of a line: words, the letters inside them, pairs of words, length, kind of end."""
    line = line.lower()
    words, looks = _looks(line, words_of(line))
    return [*looks, *_pairs(words), *(f for w in set(words) for f in _word_features(w))]


def fragments(line: str) -> list[str]:
    """Beginning and end of a line, as cuts leave them: short, and no notice for that."""
    words = line.split()
    return [" ".join(words[:1]), " ".join(words[-2:]), line[-len(line) // 3 :].strip()] if len(words) > 2 else [line[: len(line) // 2], line[len(line) // 2 :]]


class Notices:
    """Logistic regression over the features of lines; the same for the same rows."""

    def __init__(self, corpus: list[str] = ()):
        good, bad = [features(x) for x in shown()], [features(x) for x in ordinary()]
        lines = [features(x) for line in sorted(set(corpus)) for x in (line, *fragments(line))]
        rows = good + bad + lines
        y = np.array([1.0] * len(good) + [0.0] * (len(bad) + len(lines)))
        # Lines of the corpus together weigh as much as the labelled notices, whatever their number.
        weight = np.array([1.0] * (len(good) + len(bad)) + [min(1.0, len(good) / max(1, len(lines)))] * len(lines))
        index: dict = {}
        columns = np.array([index.setdefault(f, len(index)) for r in rows for f in r])
        at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        scale = 1 / np.sqrt(np.array([len(r) for r in rows]))
        weights, grad = np.zeros(len(index)), np.full(len(index), 1e-4)
        for _ in range(EPOCHS):
            z = np.bincount(at, weights[columns], len(rows)) * scale
            q = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight * scale
            g = np.bincount(columns, q[at], len(index)) / weight.sum() + DECAY * weights
            grad += g * g
            weights -= RATE * g / np.sqrt(grad)
        self.weights = {f: w for f, w in zip(index, weights.tolist())}
        self.words: dict[str, tuple[float, int]] = {}
        self.ids: dict[str, int] = {}

    def _word(self, w: str) -> tuple[float, int]:
        """What a word adds, and its number of features; kept, as words recur."""
        if (got := self.words.get(w)) is None:
            own = _word_features(w)
            got = (sum(self.weights.get(f, 0.0) for f in own), len(own))
            if len(self.words) > 200_000:
                self.words.clear()
            self.words[w] = got
        return got

    def score(self, line: str, words: list[str] | None = None) -> float:
        """Log-odds that a line is a notice; words are those of the line in small letters, where they are known."""
        if words is None:
            words = words_of(line := line.lower())
        words, looks = _looks(line, words)
        pairs, get = _pairs(words), self.weights.get
        total, n = sum(get(f, 0.0) for f in looks) + sum(get(p, 0.0) for p in pairs), len(looks) + len(pairs)
        for w in set(words):
            a, k = self._word(w)
            total, n = total + a, n + k
        return total / math.sqrt(n)

    def scores(self, lines: list[str], words: list[list[str]]) -> list[float]:
        """The scores of many lines in small letters, given with their words."""
        out: list[float] = []
        part: list[int] = []
        n = 0
        for k, own in enumerate(words):
            if len(own) > LONG or n > AT_ONCE:
                out += self._together([lines[i] for i in part], [words[i] for i in part])
                part, n = [], 0
            if len(own) > LONG:
                out.append(self.score(lines[k], own))
            else:
                part.append(k)
                n += len(own)
        return out + self._together([lines[i] for i in part], [words[i] for i in part])

    def _together(self, lines: list[str], words: list[list[str]]) -> list[float]:
        """What score adds up for each of several lines, by the numbers of their words."""
        if not lines:
            return []
        if not self.ids or len(self.ids) > MOST_WORDS:
            self._number_anew()
        looks, spoken, kept = 0, [], self.looks
        total = np.zeros(len(lines))
        for k, (line, own) in enumerate(zip(lines, words)):
            own, seen = _looks(line, own)
            if (got := kept.get(seen)) is None:
                got = kept[seen] = sum(self.weights.get(f, 0.0) for f in seen)
            total[k], looks = got, len(seen)
            spoken.append(own)
        flat = [w for own in spoken for w in own]
        found = list(map(self.ids.get, flat))
        if None in found:
            found = [self._number(w) if i is None else i for w, i in zip(flat, found)]
        word, size = np.array(found, dtype=np.int64), np.array([len(own) for own in spoken])
        each, some = np.arange(len(lines)), size > 0
        line, end = np.repeat(each, size), np.cumsum(size)
        # Every word is paired with what stands before it, the end of a line with its last word, or its beginning if it has none.
        begin, plain, last = self.ids["^"], self.plain[word], np.full(len(lines), self.ids["^"])
        before = np.concatenate([[begin], plain])[:-1]
        before[(end - size)[some]] = begin
        last[some] = plain[end[some] - 1]
        pairs = _distinct(np.concatenate([(line << 2 * WORD_BITS) + (before << WORD_BITS) + plain, (each << 2 * WORD_BITS) + (last << WORD_BITS) + self.ids["$"]]))
        own = _distinct((line << WORD_BITS) + word)
        line, word = own >> WORD_BITS, own & (1 << WORD_BITS) - 1
        total += np.bincount(line, self.added[word], len(lines))
        n = looks + np.bincount(line, self.features[word], len(lines)) + np.bincount(pairs >> 2 * WORD_BITS, minlength=len(lines))
        if len(self.pairs):
            key = pairs & (1 << 2 * WORD_BITS) - 1
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            hit = self.pairs[at] == key
            total += np.bincount(pairs[hit] >> 2 * WORD_BITS, self.pair_weights[at[hit]], len(lines))
        return (total / np.sqrt(n)).tolist()

    def _number_anew(self) -> None:
        """Only the words of known pairs keep numbers; others get theirs when they are met."""
        self.ids.clear()
        self.looks: dict[tuple[str, ...], float] = {}
        self.added, self.features, self.plain = np.zeros(4096), np.zeros(4096), np.zeros(4096, dtype=np.int64)
        for w in ("^", "$", "0"):
            self._number(w)
        known = {(self._number(f[0]) << WORD_BITS) + self._number(f[1]): w for f, w in self.weights.items() if isinstance(f, tuple)}
        self.pairs = np.array(sorted(known), dtype=np.int64)
        self.pair_weights = np.array([known[k] for k in self.pairs.tolist()])

    def _number(self, w: str) -> int:
        """The number of a word: what it adds, its number of features and its number within pairs are kept under it."""
        if (got := self.ids.get(w)) is None:
            got = self.ids[w] = len(self.ids)
            if got == len(self.added):
                self.added, self.features, self.plain = (np.concatenate([x, np.zeros_like(x)]) for x in (self.added, self.features, self.plain))
            own = _word_features(w)
            self.added[got], self.features[got] = sum(self.weights.get(f, 0.0) for f in own), len(own)
            self.plain[got] = self.ids["0"] if w.isdigit() and w != "0" else got
        return got


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Every key once, in order."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
