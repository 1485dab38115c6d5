"""Labelled seed texts for the residue models: filler, page notices, natural prose, and sentences around template blanks.

Written for this project, from the stock phrases of web servers, browsers and page builders and from plain sentences of four languages; no
text is taken from a table (a test compares runs of words). Filler in Latin looks and repeated filler words are made by rule.
"""

from __future__ import annotations

import random

#: The usual filler text of typesetters.
LATIN = (
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. "
    "Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. "
    "Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. "
    "Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum. "
    "Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium, totam rem aperiam. "
    "Nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit, sed quia consequuntur magni dolores eos qui ratione. "
    "At vero eos et accusamus et iusto odio dignissimos ducimus qui blanditiis praesentium voluptatum deleniti atque corrupti quos dolores. "
    "Vivamus sagittis lacus vel augue laoreet rutrum faucibus. Maecenas faucibus mollis interdum. Curabitur blandit tempus porttitor. "
    "Nulla vitae elit libero, a pharetra augue. Cras justo odio, dapibus ac facilisis in, egestas eget quam. Donec ullamcorper nulla non metus auctor fringilla. Praesent commodo cursus magna, vel scelerisque nisl nonummy facilisi. Morbi leo risus, porta ac vulputate at, euismod nec velit. "
    "Integer posuere erat a ante venenatis dapibus posuere velit aliquet. Aenean lacinia bibendum nulla sed consectetur. Nullam quis risus eget urna mollis ornare."
)

#: Words that people repeat where a text should stand.
REPEATED = "hello hi text word words name sample1 test testing blah bla asdf asdfasdf qwer qwerty qwertz foo bar baz xxx xxxx xyz aaa bbb ccc abc 123 1234 yada la lalala dummy sample placeholder tbd tbc tba todo text hjkl jkl zzz lol ipsum lorem".split()

#: Phrases of layouts that still wait for their text.
WAITING = [
    "Your text goes here.", "Text goes here.", "Enter your text here.", "Add a description here.", "Insert content here.", "Type something here.", "Write your story here.", "Replace this with your own words.", "Your headline here.", "Subtitle goes here.",
    "This is a sample page.", "This is dummy copy.", "This is placeholder text.", "Placeholder copy.", "Sample text.", "Example text.", "Filler text.", "Dummy text.", "Body text.", "Body copy to come.", "Insert paragraph here.", "Insert your heading here.", "Insert image caption here.", "Put your paragraph here.", "Your description here.", "Your paragraph text.", "Texto de muestra.", "Texto simulado.", "Muestra de texto.", "Exemple de texte.", "Texte exemple.", "Textbeispiel.", "Hier könnte ein Text stehen.", "Lorem.", "Text to follow.", "Copy to follow.", "Copy to be supplied.",
    "Content coming soon.", "Coming soon.", "More to come.", "Details to follow.", "Description pending.", "To be written.", "To be announced.", "To be confirmed.", "To be done.", "Draft, do not publish.", "Replace before going live.", "Placeholder paragraph.", "Paragraph of placeholder text.",
    "Blindtext.", "Platzhaltertext.", "Platzhalter, bitte austauschen.", "Mustertext.", "Beispieltext.", "Fülltext.", "Hier steht bald ein Text.", "Ihr Text hier.", "Hier Text eingeben.", "Hier kommt die Beschreibung hin.", "Inhalt folgt.", "Text folgt.",
    "Texto de relleno.", "Texto de prueba.", "Texto provisional.", "Texto pendiente.", "Escriba su texto.", "Su texto aquí.", "Aquí irá el contenido.", "Descripción pendiente.", "Próximamente.", "Contenido por añadir.",
    "Texte de remplissage.", "Faux texte.", "Texte provisoire.", "Saisissez votre texte.", "Votre texte ici.", "Le contenu viendra ici.", "Description à compléter.", "Bientôt disponible.", "Texte à rédiger.",
    "Title tbd, author tbd, date tbd.", "name: tbd\nlink: tbd\nowner: tbd", "- bullet one\n- bullet two\n- bullet three", "- list item\n- list item\n- list item", "Item 1\nItem 2\nItem 3", "TBD", "TBC", "n/a n/a n/a", "- entry one\n- entry two", "Heading\nSubheading\nBody",
]


def _filler(seed: int = 5) -> list[str]:
    """Latin in its usual order and shuffled, with words cut or given other endings; waiting phrases alone and repeated; repeated words."""
    r = random.Random(seed)
    out = [s.strip() + "." for s in LATIN.split(".") if s.strip()]
    words = [w.strip(".,").lower() for w in LATIN.split()]
    for _ in range(80):
        some = r.sample(words, 18)
        turned = [w if r.random() < 0.5 or len(w) < 5 else w[: r.randint(3, 5)] + r.choice(["", "us", "um", "is", "a", "o", "at", "em", "or", "it", "os", "ar"]) for w in some]
        out.append(" ".join(turned).capitalize() + ".")
    for p in WAITING:
        out.append(f"{p} {p} {p}")
    for _ in range(20):
        out.append(" ".join(r.sample(WAITING, 5)))
    for w in REPEATED:
        out.append(" ".join([w] * 14))
    for _ in range(6):
        out.append(" ".join(r.choice(REPEATED[:12]) for _ in range(14)))
    return out


FILLER = _filler()

_SUBJECTS = {
    "en": ["The page", "This page", "The article", "This document", "The resource", "The requested address", "The file", "This entry", "The topic", "The content"],
    "de": ["Die Seite", "Diese Seite", "Der Artikel", "Das Dokument", "Die Datei", "Der Eintrag", "Der Inhalt", "Die angeforderte Adresse"],
    "es": ["La página", "Esta página", "El artículo", "El documento", "El archivo", "El contenido", "La dirección solicitada"],
    "fr": ["La page", "Cette page", "L'article", "Le document", "Le fichier", "Le contenu", "L'adresse demandée"],
}
_STATES = {
    "en": [
        "was not found", "could not be found on this server", "does not exist", "no longer exists", "has moved", "has been deleted or renamed", "is missing", "is gone", "cannot be shown", "cannot be displayed", "failed to load", "did not load", "is temporarily unavailable", "is not available",
        "is blocked in your country", "requires JavaScript", "needs scripts to work", "will not work without JavaScript", "requires you to log in", "needs cookies to be turned on", "has expired", "was blocked", "is locked", "timed out", "took too long to load", "took too long", "could not be located", "could not be reached", "could not be opened", "isn't here", "is not responding", "is being upgraded", "demands that scripts are allowed",
    ],
    "de": ["wurde nicht gefunden", "existiert nicht mehr", "ist umgezogen", "wurde gelöscht", "kann momentan nicht geladen werden", "ist nicht erreichbar", "ist vorübergehend nicht verfügbar", "benötigt JavaScript", "funktioniert nicht ohne JavaScript", "braucht aktivierte Skripte", "erfordert eine Anmeldung", "ist abgelaufen", "wurde gesperrt", "ist leider nicht verfügbar", "konnte nicht geöffnet werden"],
    "es": ["no se ha encontrado", "no existe", "ya no existe", "ha cambiado de sitio", "fue eliminado", "no se puede mostrar", "no pudo cargarse", "no está disponible temporalmente", "necesita JavaScript", "no funciona sin JavaScript", "requiere activar los scripts", "requiere iniciar sesión", "ha caducado", "ha sido bloqueado", "ha sido bloqueada", "no está disponible", "no está disponible ahora mismo", "no se pudo abrir", "exige permitir los scripts"],
    "fr": ["n'a pas été trouvée", "n'existe pas", "n'existe plus", "a été déplacée", "a été supprimé", "ne peut pas être affichée", "n'a pu être chargé", "est temporairement indisponible", "nécessite JavaScript", "ne fonctionne pas sans JavaScript", "exige l'activation des scripts", "demande une connexion", "a expiré", "a été bloqué", "a été bloquée", "n'est pas disponible pour l'instant", "n'a pu être ouverte", "exige d'autoriser les scripts", "exige que l'on permette les scripts"],
}

#: Stock phrases of servers, gateways, browsers and pages.
PHRASES = [
    "404 Not Found", "Error 404", "HTTP Error 404. The requested resource is not found.", "404 - File or directory not found.", "Not Found", "Page not found", "410 Gone", "403 Forbidden", "Forbidden: you don't have permission to access this resource.", "401 Unauthorized", "400 Bad Request",
    "Your browser sent a request that this server could not understand.", "405 Method Not Allowed", "408 Request Timeout", "429 Too Many Requests", "Rate limit exceeded. Slow down.", "500 Internal Server Error", "The server encountered an internal error or misconfiguration and was unable to complete your request.",
    "502 Bad Gateway", "503 Service Unavailable", "503 Backend fetch failed. Guru Meditation: XID: 4711", "504 Gateway Timeout", "The gateway did not receive a timely response from the upstream server.", "upstream connect error or disconnect/reset before headers", "upstream request timeout", "no healthy upstream", "Error 520: web server is returning an unknown error",
    "nginx", "nginx/1.18.0 (Ubuntu)", "Apache/2.4.41 (Ubuntu) Server at example.net Port 443", "openresty", "Varnish cache server", "IIS Windows Server", "<html><head><title>Not Found</title></head><body><center><h1>Not Found</h1></center><hr></body></html>", "<h1>Service Unavailable</h1><p>Please retry shortly.</p><hr>",
    "<html><body><h1>Error</h1><p>Request failed.</p></body></html>", "<title>Gateway error</title>", "<hr><address>Server</address>", "{\"error\": \"not found\", \"status\": 404}", "{\"code\":500,\"message\":\"internal server error\",\"requestId\":\"a81f93bc\"}", "{\"errors\":[{\"status\":\"503\",\"title\":\"unavailable\",\"trace_id\":\"9e107d9d372b\"}]}", "{\"success\":false,\"error\":\"forbidden\"}",
    "Traceback (most recent call last): File \"app.py\", line 88, in handle", "Exception in thread \"main\" java.lang.NullPointerException at com.example.web.Handler.render(Handler.java:120)", "Fatal error: Uncaught Error: Call to undefined function in /var/www/index.php on line 42", "Warning: include(): failed opening header.php for inclusion", "Notice: Undefined variable in template on line 9",
    "TypeError: Cannot read properties of undefined", "TemplateSyntaxError: unexpected end of template", "Template rendering failed: missing block body, id 1f8ac10f", "Unhandled exception. Stack trace follows.", "Segmentation fault", "SQLSTATE[HY000] [2002] Connection refused", "Error establishing a database connection", "Could not connect to the database.", "Too many connections", "Database query failed.", "Out of memory",
    "Something went wrong.", "Oops, something broke on our end.", "Sorry, an unexpected error occurred.", "An unknown error happened. Try again.", "Please try again in a few minutes.", "Please come back later.", "Try reloading.", "Try again later.", "Later, please.", "Sorry!", "Sorry about the trouble.", "Apologies for the inconvenience.", "We looked but there is no such page.", "A firewall stopped this request.", "A security rule stopped it.", "The upstream server sent no answer.", "no answer from upstream", "HTTP 500", "HTTP 403 Forbidden", "Site owners can find more in the logs.", "Report this to the administrator.", "The administrator can tell you more.", "Contact the site administrator.", "If it happens again, write to the administrator.", "The site owner must look at the logs.", "Own this website? See the server log.", "You probably mistyped something.", "Mistyped link?", "A typing mistake in the address?", "Took too long to answer.", "The answer took too long (504).", "The server gave no answer in time.",
    "upstream timed out", "Sign in once more.", "Sign in again to go on.", "Your session is over; sign in again.", "This session has ended.", "The session expired because of inactivity.", "Only for humans: prove it with one click.", "Are you human? This takes a moment.", "We check that you are no bot.", "This will take only a few seconds.", "Nothing here.", "Nothing happens? See whether scripts are permitted.", "If nothing loads, scripts may be forbidden.", "It looks like JavaScript is off.", "It seems that scripts are not enabled here.",
    "Can't load: scripting is off.", "Can't start without scripts.", "Cannot run: JavaScript off.", "Cookies are required.", "Scripts are required here.", "JavaScript and cookies are required to use this website.", "Required: cookies, scripts.", "The help page could not be loaded.", "This help topic took too long.", "Help page missing", "The thread could not be opened.", "This discussion is gone.", "This comment was removed.", "The topic was locked by a moderator.", "The service is unavailable while we do maintenance.", "We are doing some work on the site.", "Service unavailable for now.", "Service down.",
    "Traceback: block failed in template, line 210", "template error in block body, line 12, id 90ce33", "render failed", "Error in template, line 77", "Exception id 77ab2c90", "status 500", "status 408", "code 502", "error 410", "erreur 403", "Fehler 500", "error 503 (código)", "Firewall: request stopped.", "Stopped by our web application firewall.", "Page at www.example.net not located.", "The document at docs.example.net could not be reached.", "Oops!", "Oops, we looked but found no page.", "Hmm, this page isn't here.",
    "We can't seem to find this page.", "Sorry, we couldn't find that.", "That page doesn't seem to exist.", "Page missing. Go to the start page.", "Go home", "Take me back", "Back to safety", "The proxy server received an invalid response.", "Invalid response from upstream.", "Proxy error", "The proxy could not handle the request.", "Bad request: invalid header", "Invalid token", "Invalid session", "Invalid request.", "Missing parameter", "Malformed URL", "Unauthorized: sign in first.", "Please sign in.", "Please sign in to proceed.", "Login required",
    "Please wait while we check your browser.", "Please stand by while the security check runs.", "Verifying your connection", "Verification required", "Press and hold to confirm that you are human.", "Unusual traffic from your computer network.", "Automated access is not allowed.", "Bots are not allowed.", "Error page: the application has no mapping for this address.", "No explicit handler for /index.", "Route not defined", "No route matches", "Method not implemented", "Action not found", "Page cannot be rendered", "View missing", "Application failed to start", "Application error. See the logs for details.", "client-side exception", "Unhandled rejection", "Network error", "Failed to fetch", "Chunk load error",
    "The site is down for an upgrade.", "We'll be back soon, check back shortly.", "Back online soon.", "Closed for repairs: website", "Temporarily down.", "Your browser is out of date. Update it.", "Update your browser.", "Outdated browser.", "This browser is too old.", "You are being redirected.", "Redirecting you, please wait.", "Click here if you are not redirected.", "Viewing this folder is not allowed.", "Directory listing denied.", "Disk quota exceeded.", "Bandwidth limit exceeded", "Account suspended. This hosting account has been suspended.", "This domain is parked.", "Default web page", "It works! This is the default page of the server.", "Hosting placeholder",
    "Wir führen Wartungsarbeiten durch.", "Wir arbeiten gerade an der Seite.", "Die Seite wird gewartet.", "Bitte warten, Ihr Browser wird geprüft.", "Ihr Browser ist veraltet, bitte aktualisieren.", "Anmeldung erforderlich.", "Bitte melden Sie sich an.", "Ungültige Anfrage.", "Zu viele Anfragen.", "Diese Adresse gibt es nicht.", "Estamos realizando tareas de mantenimiento.", "La página está en obras.", "Espere, comprobamos su navegador.", "Su navegador está anticuado, actualícelo.", "Debe iniciar sesión.", "Solicitud no válida.", "Demasiadas peticiones.", "Esa dirección no existe.",
    "Nous effectuons une maintenance.", "Le site est en travaux.", "Patientez, nous vérifions votre navigateur.", "Votre navigateur est obsolète, mettez-le à jour.", "Connexion requise.", "Veuillez vous connecter.", "Requête non valide.", "Trop de requêtes.", "Cette adresse n'existe pas.", "Ce contenu a été retiré.", "Der Inhalt wurde entfernt.", "El contenido fue retirado.", "Le lien est périmé (erreur 410).", "El enlace está caducado (error 410).", "Der Link ist abgelaufen (Fehler 410).", "An upgrade is in progress.", "An update of the site is running.", "A human check takes a few moments.", "We make sure that you are human.", "Search", "Community", "Help", "Join", "Register | Log in", "Trace 8f2e01", "ID 4be1c09a77", "Refresh to try again.", "If the problem persists, contact the webmaster.", "If you are the owner of this website, look into the server logs.", "We have been notified and are working on it.", "Whoops! That link is broken.", "You may have typed the address wrong.",
    "Check the address for typos.", "There is nothing at this address.", "We can't find what you were looking for.", "The link you followed may be out of date.", "This site can't be reached.", "The connection was reset.", "ERR_CONNECTION_TIMED_OUT", "DNS_PROBE_FINISHED_NXDOMAIN", "Server not found. The host name could not be resolved.", "Your connection is not private.", "The request timed out.", "Took too long to respond.", "The server is too busy. Retry later.", "The server is overloaded.",
    "Down for maintenance", "We are performing scheduled maintenance.", "This website is undergoing maintenance and will be back shortly.", "Planned works are under way.", "We'll be right back.", "Site under construction.", "Temporarily offline.",
    "Please enable JavaScript.", "Enable JavaScript and reload the page.", "JavaScript is required.", "JavaScript must be enabled to view this content.", "JavaScript seems to be switched off in this browser.", "You have disabled JavaScript.", "You need JavaScript to use this application.", "To continue, turn on scripts in the browser settings.", "Scripts are blocked.", "Scripts must be allowed for this site.", "Activate JavaScript to see the comments.", "Switch scripting on and refresh.",
    "Cookies are disabled. Please allow cookies.", "This app needs cookies and JavaScript.", "Your browser does not run scripts.", "Your browser is too old and not supported.", "Please upgrade to a modern browser.", "Unsupported browser version.", "<noscript>This application needs JavaScript. Please turn it on.</noscript>", "<noscript>You must enable JavaScript to run this app.</noscript>", "Loading, please wait...", "Loading application",
    "Ad blocker found. Please switch it off to read this.", "Please disable your ad blocker.", "Turn off the content blocker for this page.", "Are you a robot?", "Verify that you are a human.", "Please complete the security check to access the site.", "Checking your browser. This may take some seconds.", "One more step: solve the captcha.", "Just a moment...", "DDoS protection", "Ray ID: 7d2f0a4c9b1e33aa", "Request ID 5c0d9a7e41", "Reference number 18.3f1c2e17", "Incident 92ab-11",
    "Access denied", "You do not have access to this page.", "You have been blocked.", "Your request was blocked by the firewall.", "Suspicious activity was detected from your network.", "You must be logged in.", "Please log in to view this content.", "Session expired. Please log in again.", "You have been signed out.", "Your session timed out.", "Not available in your region.", "This content is private.", "Insufficient rights.", "License required",
    "Home | About | Contact | Login", "Home / Support / Error", "Skip to main content", "Menu Search Login", "Go back to the start page", "Return to the homepage", "Back", "Retry", "Reload", "Contact support", "Sitemap | Privacy policy | Terms of use", "Copyright 2021. All rights reserved.", "(c) 2020 Example Inc.", "Powered by Example CMS", "Imprint | Privacy", "Search this site", "Share | Print", "Status page", "Privacy Terms Cookies", "Sign up Log in Help",
    "Seite nicht gefunden", "Fehler 404: Die Adresse gibt es nicht.", "Interner Serverfehler", "Ein unerwarteter Fehler ist aufgetreten.", "Bitte laden Sie die Seite neu.", "Bitte versuchen Sie es in einigen Minuten noch einmal.", "Der Server antwortet nicht.", "Der Dienst ist zurzeit überlastet.", "Zugriff verweigert", "Sie haben keine Berechtigung.", "Wartungsarbeiten: Wir sind gleich zurück.", "Später noch einmal versuchen.", "Entschuldigung!", "Anfrage gesperrt.", "Bitte JavaScript aktivieren.", "JavaScript ist in Ihrem Browser ausgeschaltet.", "Aktivieren Sie JavaScript, um weiterzumachen.",
    "Bitte erlauben Sie Skripte und Cookies.", "Ihr Browser wird nicht unterstützt.", "Ihre Sitzung ist abgelaufen. Melden Sie sich erneut an.", "Der Link ist ungültig.", "Zur Startseite", "Dieser Link führt ins Leere.", "Bitte Werbeblocker ausschalten.",
    "Página no encontrada", "Error 404: la dirección no existe.", "Error interno del servidor", "Ha ocurrido un error inesperado.", "Inténtelo de nuevo en unos minutos.", "Recargue la página.", "El servidor no responde.", "Servicio saturado.", "Acceso denegado", "No tiene permiso para ver esto.", "Sitio en mantenimiento: volvemos enseguida.", "Pruebe más tarde.", "Inténtelo más tarde.", "Vuelve más tarde.", "Petición bloqueada.", "Active JavaScript, por favor.", "JavaScript está desactivado en su navegador.", "Habilite JavaScript para continuar.", "Permita los scripts y las cookies.",
    "Su navegador no es compatible.", "La sesión ha caducado. Vuelva a entrar.", "El enlace no es válido.", "Volver al inicio", "El enlace está roto.", "Desactive el bloqueador de anuncios.",
    "Page introuvable", "Erreur 404 : cette adresse n'existe pas.", "Erreur interne du serveur", "Une erreur inattendue est survenue.", "Veuillez réessayer dans quelques minutes.", "Rechargez la page.", "Le serveur est surchargé.", "Service indisponible", "Accès refusé", "Vous n'avez pas la permission.", "Site en maintenance : nous revenons vite.", "Réessayez plus tard.", "Désolé !", "Requête bloquée.", "Veuillez activer JavaScript.", "JavaScript est désactivé dans votre navigateur.", "Activez JavaScript pour poursuivre.", "Autorisez les scripts et les cookies.",
    "Votre navigateur n'est pas pris en charge.", "Votre session a expiré. Reconnectez-vous.", "Ce lien n'est pas valide.", "Retour à l'accueil", "Le lien est rompu.", "Désactivez le bloqueur de publicités.",
]

#: Pieces of notices that scripts, cookies or a newer browser are wanted: verb, what, where or why.
_WANTED = {
    "en": (
        ["enable", "turn on", "switch on", "activate", "allow", "permit", "please enable", "please allow", "please activate", "you must enable", "you need to turn on", "you have to allow", "you did not enable", "turn off", "you have disabled", "kindly switch on"],
        ["JavaScript", "scripts", "scripting", "active scripting", "client-side scripts", "cookies", "JavaScript and cookies", "scripts and cookies", "cookies and scripts", "your script blocker", "your ad blocker"],
        ["in this browser", "in your browser settings", "in your settings", "to continue", "to go further", "to read on", "to use this site", "to use the service", "to see this page", "to view the comments", "before you continue", "then reload", "then refresh", "and reload the page", "and try again", "for this site", "or use another browser"],
    ),
    "de": (
        ["aktiviere", "aktivieren Sie", "bitte aktiviere", "bitte erlaube", "erlauben Sie", "schalte", "Sie müssen", "du musst"],
        ["JavaScript", "Skripte", "die Skripte", "Cookies", "JavaScript und Cookies", "aktive Skripte"],
        ["im Browser", "in den Einstellungen", "um fortzufahren", "um weiterzulesen", "und lade neu", "ein", "und laden Sie die Seite neu", "einschalten", "für diese Seite"],
    ),
    "es": (
        ["activa", "active", "habilita", "permite", "permita", "es necesario activar", "debes activar", "tienes que permitir"],
        ["JavaScript", "los scripts", "las cookies", "JavaScript y cookies", "los scripts del sitio"],
        ["en el navegador", "en los ajustes", "para continuar", "para ver la página", "para seguir leyendo", "y recarga", "y vuelve a cargar", "en este sitio"],
    ),
    "fr": (
        ["activez", "veuillez activer", "autorisez", "veuillez autoriser", "il faut activer", "vous devez autoriser", "merci d'activer"],
        ["JavaScript", "les scripts", "les cookies", "JavaScript et les cookies", "l'exécution des scripts"],
        ["dans le navigateur", "dans les réglages", "pour continuer", "pour voir la page", "pour lire la suite", "puis rechargez", "et rechargez la page", "pour ce site"],
    ),
}


#: Subjects and predicates of failures, combined by rule.
_FAILING = {
    "en": (
        "the gateway, the server, the upstream host, the proxy, the service, the connection, the request, your request, the session, your login, your account, this folder, this area, this section, the application, the database, the firewall, this view, the link, the website, the network, your access, your address, the token, the certificate, the download".split(", "),
        "got no reply, gave no usable answer, did not respond in time, returned an error, is down, is down for repairs, is being maintained, is closed for maintenance, failed, was refused, was denied, timed out, is no longer valid, is invalid, was blocked, lacks the rights, is not allowed, was interrupted, crashed, is overloaded, needs a login, is restricted, was rejected, cannot be opened, could not be established, is limited to members, was closed, is offline, has been disabled, is not permitted here, took too much time".split(", "),
        "check back later, try once more, hold on, please wait, sign in first, reload, we are on it, come back in an hour, contact the operator, error 502, error 403, code 500, status 404, so that the page can load, not allowed, we are checking, you are no bot, identify yourself, log in to read this".split(", "),
    ),
    "de": (
        "der Server, das Gateway, der Dienst, die Verbindung, die Anfrage, die Sitzung, Ihre Anmeldung, der Zugang, der Zugriff, dieser Bereich, diese Ansicht, die Anwendung, die Datenbank, der Link, die Website".split(", "),
        "antwortet nicht, hat zu lange gebraucht, ist fehlgeschlagen, wurde abgelehnt, wurde verweigert, ist nicht erlaubt, wird gewartet, ist gestört, ist gesperrt, ist überlastet, wurde unterbrochen, ist ungültig, benötigt eine Anmeldung, ist offline, konnte nicht hergestellt werden, ist nur für Mitglieder".split(", "),
        "bitte später wiederkommen, bitte neu laden, bitte melden Sie sich an, wir arbeiten daran, bitte warten, versuchen Sie es erneut, Fehler 502, Fehler 403, erst anmelden".split(", "),
    ),
    "es": (
        "el servidor, la pasarela, el servicio, la conexión, la solicitud, la sesión, el acceso, esta sección, la aplicación, la base de datos, el enlace, el sitio".split(", "),
        "no responde, tardó demasiado, ha fallado, fue rechazada, fue denegado, no está permitido, está en mantenimiento, está bloqueado, está saturado, se interrumpió, no es válida, requiere identificarse, no está en línea, no pudo establecerse, es solo para miembros, cambió de dirección".split(", "),
        "vuelva más tarde, recargue, identifíquese, espere un momento, estamos en ello, pruebe otra vez, error 502, error 403, entre primero".split(", "),
    ),
    "fr": (
        "le serveur, la passerelle, le service, la connexion, la requête, la session, l'accès, cette section, l'application, la base de données, le lien, le site".split(", "),
        "ne répond pas, a mis trop de temps, a échoué, a été refusée, est interdit, n'est pas autorisé, est en maintenance, est bloqué, est saturé, a été interrompue, n'est pas valide, exige une identification, est hors ligne, n'a pu être établie, est réservé aux membres".split(", "),
        "revenez plus tard, rechargez, identifiez-vous, connectez-vous, patientez, nous y travaillons, réessayez, erreur 502, erreur 403, pour accéder à ce contenu".split(", "),
    ),
}


def _failing(seed: int = 8, number: int = 700) -> list[str]:
    r = random.Random(seed)
    out = []
    for i in range(number):
        who, what, then = _FAILING[("en", "en", "en", "de", "es", "fr")[i % 6]]
        text = f"{r.choice(who)} {r.choice(what)}"
        pick = r.random()
        text = text if pick < 0.4 else f"{text}, {r.choice(then)}" if pick < 0.7 else f"{text}. {r.choice(then).capitalize()}" if pick < 0.85 else f"{r.choice(then)}: {text}"
        out.append(text[0].upper() + text[1:] + ".")
    return out


def _wanted(seed: int = 6, number: int = 320) -> list[str]:
    r = random.Random(seed)
    out = []
    for i in range(number):
        verb, what, why = _WANTED[("en", "en", "de", "es", "fr")[i % 5]]
        out.append(f"{r.choice(verb)} {r.choice(what)} {r.choice(why)}.".capitalize() if r.random() < 0.8 else f"{r.choice(why)}, {r.choice(verb)} {r.choice(what)}.".capitalize())
    return out


NOTICE = PHRASES + [f"{s} {v}." for k in _SUBJECTS for s in _SUBJECTS[k] for v in _STATES[k]] + _wanted() + _failing()

PROSE = [
    "My headphones keep dropping the sound whenever I walk away from the computer, and pairing them again only helps for a minute.",
    "Thank you for your patience. A colleague has refunded the amount and you will see it on your statement next week.",
    "If you want another plan, open your profile, pick the one you like and confirm the purchase by mail.",
    "Since we moved house, the invitation for my daughter's membership has never shown up in her inbox.",
    "I really like the fresh design, although the lyrics scroll too fast and the dark colours strain my eyes at night.",
    "The agent explained that the album had been withdrawn by its label and promised to write again on Monday.",
    "A shared list belongs to everyone who follows it; anybody may add a song, and only the owner may delete it.",
    "Two engineers read the log, found the broken cable and replaced it before lunch.",
    "Every evening the kitchen radio goes silent at seven, then starts again with the wrong station.",
    "The fee of 4.50 is for the yearly subscription, and the voucher was used by your brother in April.",
    "Agent: How can I help?\nCustomer: The tablet forgets my downloads as soon as the train enters a tunnel.\nAgent: Which model is it?",
    "Before you delete the folder, make a copy, check that it opens and tell the others where it is.",
    "Release 3.4 adds a timer for sleep, repairs the alarm and makes the start screen load faster.",
    "Most of my friends in the village have had no trouble at all, which makes the whole thing even stranger.",
    "During the trial month you may listen without advertisements, and you can leave at any time without paying.",
    "Ticket 2210 went to the network people, who asked for the serial number and a photo of the label.",
    "Could somebody look at my invoice? It lists two devices, but there is only one in our home.",
    "He asked me to sign out everywhere, change the password and start the phone again; nothing changed.",
    "While the farmer mends the fence, his sister counts the sheep and writes the number into a blue notebook.",
    "An honest answer would say sorry first, then name the reason, and offer something useful in the end.",
    "If the bridge is closed, suppose a bus takes twice as long; how many passengers reach the station before eight?",
    "The librarian sorts the returned books by colour because the labels fell off during the flood.",
    "Customer [CUSTOMER] wrote from [EMAIL] and left [PHONE]; see the link [URL] in our notes. The case was closed on Tuesday.",
    "Songs marked (live) or [remix] play fine on the speaker but not in the car, at least since spring.",
    "The cache holds a few hundred tracks, so clearing it frees some space and does no harm.",
    "To rename a list, hold it for two seconds, choose the pencil and type what you want to call it.",
    "I pay for six people and still hear adverts between the songs; is the family account broken?",
    "We passed your request on to the team that looks after the catalogue, and they will tell you when it is back.",
    "Great service, quick answer, kind people. I would recommend it to everyone in my choir.",
    "The help entry describes how to move your music from another service with a small tool.",
    "Note for the shift: three callers asked about the gift card, none of them had the code at hand.",
    "She waited four days, then wrote a review with two stars and a long list of complaints.",
    "Please check whether the shuffle button really mixes the queue, because I hear the same ten songs all week.",
    "Ask for the order number first, then read the status, then explain the next step in simple words.",
    "Both laptops run the same system, yet only the older one shows the cover of the record.",
    "The storm took the signal away, so the concert stream stopped in the middle of the second song.",
    "A student paid thirty coins for a drum, sold it for forty and bought it back for thirty-five; what did she earn?",
    "I restarted the television twice and cleared everything, but the picture freezes after the first minute.",
    "Their reply came within an hour and solved the problem with the offline songs on my watch.",
    "Changes to the price take effect on the first day of the following month.",
    "Meine Kopfhörer verlieren ständig die Verbindung, sobald ich mich vom Rechner entferne.", "Danke für die Geduld. Der Betrag wurde erstattet und erscheint nächste Woche auf dem Konto.",
    "Wenn du einen anderen Tarif willst, öffne dein Profil und wähle ihn dort aus.", "Seit unserem Umzug kommt die Einladung für meine Tochter nicht mehr an.", "Die Agentin erklärte, dass das Label die Platte zurückgezogen hat, und versprach eine Nachricht am Montag.",
    "Jeden Abend verstummt das Radio in der Küche um sieben und spielt dann den falschen Sender.", "Ich habe das Kennwort geändert, das Telefon neu gestartet und trotzdem läuft nichts.", "Zwei Techniker lasen das Protokoll, fanden das kaputte Kabel und tauschten es vor dem Mittag aus.",
    "Der Kunde fragt, ob die Gebühr für das ganze Jahr gilt oder nur für einen Monat.", "Beim Abspielen im Auto fehlen die Texte, auf dem Rechner sind sie da.", "Unser Chor hört die Liste jede Woche, und sie gefällt allen sehr gut.", "Die neue Fassung bringt einen Wecker und lädt den Anfang schneller.",
    "Während der Bauer den Zaun flickt, zählt seine Schwester die Schafe und schreibt die Zahl in ein Heft.", "Wir haben deine Bitte an die Leute weitergegeben, die sich um den Katalog kümmern.", "Man kann die Warteschlange mischen, aber es kommen immer dieselben zehn Stücke.",
    "Mis auriculares pierden la conexión cada vez que me alejo del ordenador.", "Gracias por su paciencia. Hemos devuelto el importe y lo verá en su cuenta la semana que viene.", "Si quiere otro plan, abra su perfil y elija el que prefiera.", "Desde la mudanza, la invitación de mi hija no llega a su buzón.",
    "La agente explicó que el sello retiró el disco y prometió escribir el lunes.", "Todas las noches la radio de la cocina se calla a las siete y luego pone otra emisora.", "Cambié la contraseña, apagué el móvil y nada mejoró.", "Dos técnicos leyeron el registro, hallaron el cable roto y lo cambiaron antes de comer.",
    "El cliente pregunta si la cuota vale para todo el año o solo para un mes.", "En el coche faltan las letras, en el ordenador aparecen.", "A nuestro coro le encanta la lista y la escucha cada semana.", "La versión nueva trae un despertador y abre más rápido.",
    "Mientras el granjero arregla la valla, su hermana cuenta las ovejas y apunta el número.", "Hemos pasado su petición a quienes cuidan del catálogo.", "Se puede mezclar la cola, pero siempre suenan las mismas diez canciones.",
    "Mon casque perd la liaison dès que je m'éloigne de l'ordinateur.", "Merci de votre patience. La somme a été remboursée et paraîtra sur votre compte la semaine prochaine.", "Pour changer de formule, ouvrez votre profil et choisissez celle qui vous plaît.", "Depuis notre déménagement, l'invitation de ma fille n'arrive jamais.",
    "La conseillère a dit que le label avait retiré l'album et a promis d'écrire lundi.", "Chaque soir la radio de la cuisine se tait à sept heures puis reprend sur une autre station.", "J'ai changé le mot de passe et éteint le téléphone, sans résultat.", "Deux techniciens ont lu le journal, trouvé le câble cassé et l'ont remplacé avant midi.",
    "Le client demande si le tarif vaut pour l'année entière ou pour un seul mois.", "Dans la voiture les paroles manquent, sur l'ordinateur elles sont là.", "Notre chorale adore cette liste et l'écoute toutes les semaines.", "La nouvelle version apporte un réveil et s'ouvre plus vite.",
    "Pendant que le fermier répare la clôture, sa sœur compte les moutons et note le nombre.", "Nous avons transmis votre demande à ceux qui tiennent le catalogue.", "On peut mélanger la file, mais ce sont toujours les dix mêmes morceaux.",
    "The error came back after an hour.", "I keep getting the same error when I start it.", "Error 12 again, what shall I do?", "The loading takes ages today.", "Restart the tablet and sign in again.", "Please sign out, wait a moment and open it once more.", "Turn the speaker off and on again.", "Go to your profile and check the queue.", "Reload the list and it works.",
    "The access to my account was restored.", "My browser plays it, my phone does not.", "The server in our office hums all day.", "Der Fehler kam nach einer Stunde zurück.", "Starte das Tablet neu und melde dich wieder an.", "Schalte den Lautsprecher aus und wieder ein.", "Öffne dein Profil und sieh dir die Warteschlange an.", "Ständig derselbe Fehler beim Öffnen.", "Lade die Liste neu, dann geht es.",
    "El error vuelve siempre al cabo de una hora.", "Reinicia la tableta y entra otra vez.", "Apaga el altavoz y enciéndelo.", "Abre tu perfil y mira la cola.", "Siempre el mismo fallo al abrirla.", "Recarga la lista y funciona.", "El fallo 12 apareció por la mañana.", "L'erreur revient au bout d'une heure.", "Redémarrez la tablette et reconnectez-vous.", "Éteignez puis rallumez l'enceinte.", "Déconnectez-vous un instant, puis rouvrez votre profil.",
    "Ouvrez votre profil et regardez la file.", "Toujours la même erreur à l'ouverture.", "Rechargez la liste et tout va bien.", "L'erreur 12 est apparue ce matin.", "Die Störung meldet sich seit gestern mit einer Nummer.", "Cierra todo, espera un momento y abre de nuevo.", "Fermez tout, attendez un peu et recommencez.",
    "El caso está con los técnicos.", "El caso 12 sigue abierto con el equipo.", "Le dossier est entre les mains des techniciens.", "Der Fall liegt bei den Technikern.", "Ceux qui suivent ce chanteur voient deux fois la pochette.", "Quienes siguen a la cantante ven la portada repetida.", "Wer dieser Sängerin folgt, sieht das Bild doppelt.", "On the tablet the list now has a small permission for friends.", "If the desktop program will not sync, reset the timer first.", "You need not do anything; the songs return by noon.", "On the watch there is a new private mode.",
    "La cantante volvió al catálogo.", "Le morceau est revenu dans le catalogue.", "Das Stück ist wieder im Katalog.", "Falta la canción en mi lista del coche.", "Il manque un titre dans ma liste.", "Yes, that worked, thank you so much!", "ok thanks", "No, still the same here.", "done, it plays again", "What is the price for two people?", "Any news on this?", "Customer happy, case closed.", "Refund sent, nothing else to do.", "Gracias, ya funciona.", "Danke, jetzt geht es wieder.", "Merci, tout marche.",
]

#: Natural prose that reports or quotes residue; it counts as prose.
REPORTS = [
    "Your site told me to switch on JavaScript, though it is on, and I still cannot see my invoices.",
    "When I press the banner in your newsletter I land on a 404, so I could not use the voucher.",
    "My laptop only ever answers with access denied when I try to open the statement you sent me.",
    "I rather like the drawing on your not found page; my kids think the cat is funny.",
    "We had error 500 all morning yesterday, and after an hour everything came back by itself.",
    "Somebody left lorem ipsum in the description of the record, which made our whole office smile.",
    "The placeholder text on the printed card should be replaced, it still says sample.",
    "A friend saw a notice about maintenance last night, but the music kept playing for me.",
    "They said that cookies had to be allowed, so I allowed them, and the basket is still empty.",
    "After the captcha the browser hung, I closed it and wrote to you instead.",
    "She asked why the page said that her session had expired while she was typing a comment.",
    "In the meeting we agreed that the gateway timeout came from a full disk and not from the update.",
    "Eure Seite verlangt JavaScript, obwohl es bei mir läuft, und die Rechnungen fehlen weiterhin.",
    "Der Knopf im Rundbrief führt zu einem Fehler 404, deshalb konnte ich den Gutschein nicht nutzen.",
    "Vuestra web dice que active JavaScript, aunque lo tengo puesto, y no veo mis facturas.",
    "El botón del boletín lleva a un error 404, así que no pude usar el vale.",
    "Votre site réclame JavaScript alors qu'il est actif, et mes factures manquent toujours.",
    "Le bouton de la lettre mène à une erreur 404, je n'ai donc pas pu utiliser le bon.",
]

#: Sentences whose blank was left unfilled; ``~`` stands for the blank.
UNFILLED = [
    "Hello ~, thanks for getting in touch.", "Dear ~, your parcel left our store on ~.", "Hi ~, welcome to ~!", "Good morning ~, here is your code: ~.", "Your number is ~ and your plan is ~.", "Total: ~", "Amount due: ~ by ~.", "Kind regards, ~", "Yours sincerely, ~\n~", "Invoice ~ of ~", "Order ~ was sent to ~ on ~.",
    "Subject: ~", "To: ~", "Please call ~ between ~ and ~.", "Follow this link: ~", "See ~ for details.", "Look at ~", "Read ~ first.", "More under ~", "You can read more at ~.", "Our ~ team will reply within ~ days.", "We charged ~ to the card ending in ~.", "Next payment: ~", "It ends on ~.", "Your agent today is ~.", "Thank you ~ for choosing ~.", "Name: ~", "Code: ~", "Your code is ~.", "Your PIN is ~", "No. ~", "Invoice no. ~", "Booking number ~", "~ informs you that the shop is closed.", "~ has sent you a message.", "~ wishes you a nice day.", "To do: ~", "~ of the text", "Valid from ~ to ~.", "Phone ~", "Address: ~", "Case ~ is closed.",
    "The song ~ by ~ is back.", "Ask the ~ desk about it.", "A refund of ~ is on its way.", "Open ~ and choose ~.", "Your trial lasts until ~.", "Sent by ~ from ~.", "Sehr geehrte Frau ~,", "Hallo ~, vielen Dank für Ihre Anfrage.", "Mit freundlichen Grüßen ~", "Ihr Vertrag ~ endet am ~.", "Der Betrag von ~ wird am ~ abgebucht.",
    "Estimado ~:", "Hola ~, gracias por su mensaje.", "Saludos, ~", "Su pedido ~ salió el ~.", "El plan ~ termina el ~.", "Bonjour ~, merci de nous avoir contactés.", "Cordialement, ~", "Votre commande ~ est partie le ~.", "La formule ~ prend fin le ~.", "Restart the ~ and wait for ~ minutes.", "Hello ~, the song is back. Hi ~, I looked into it.", "See ~", "Good day ~, Agent: we will look.", "Dear ~, Customer: it stopped again.", "The new ~ arrives before ~.", "Nobody told ~ about the change of plan.",
]



def _blanked(seed: int = 7) -> list[str]:
    """Ordinary sentences in which one or two words are a blank: what an unfilled template looks like in the middle of a text."""
    r = random.Random(seed)
    out = []
    for text in PROSE:
        words = text.split(" ")
        for _ in range(3):
            place = r.randrange(len(words))
            out.append(" ".join("~" if i == place else w for i, w in enumerate(words)))
    return out


#: Sentences that report, quote or explain a blank; ``~`` stands for it.
QUOTED = [
    "The letter began with ~ where my name belongs, please correct this.", "I was addressed as ~ in the last message, is that meant to be funny?", "The mail from yesterday shows ~ instead of my first name.", "Somebody forgot to fill in ~ in your newsletter.", "Why do you call me ~?", "I was greeted as ~.", "The newsletter greets me with ~, fix the greeting please.", "Your message greeted us with ~, correct that.", "Your message called me ~, how strange.", "Your letter called her ~, that was rude.", "In a template language you write ~ to print a value.", "In Handlebars you write ~ to show the title.", "The greeting in the letter was ~.", "The text on my screen literally says ~ and nothing else.",
    "In the subject I only see ~, so the template seems broken.", "There is a bug: ~ is printed as it stands.", "Use ~ in the template and the name appears.", "Write ~ to insert the date.", "In Mustache you write ~ for a variable.", "Replace ~ with the path of your home folder.", "The variable ~ holds the user name in a shell.", "Python formats ~ as a number.", "A template with ~ prints the value.",
    "The placeholder ~ stands for the customer.", "Type ~ exactly like this and the editor fills it in.", "In the manual, ~ means that you choose the value yourself.", "The tag ~ is replaced by the system when the mail is sent.", "The code ~ returns the title.", "For example, ~ becomes the name of the reader.", "Put ~ at the start of the line.", "The syntax ~ comes from an older tool.", "The macro expands ~ when it runs.",
    "In eurer Mail steht ~ statt meines Namens.", "Ihr nennt mich ~, bitte ändert das.", "Schreibe ~ in die Vorlage, dann erscheint der Name.", "En vuestro correo pone ~ en lugar de mi nombre.", "Me llamáis ~, corregidlo por favor.", "Escribe ~ en la plantilla para mostrar el nombre.", "Votre courriel affiche ~ à la place de mon nom.", "Vous m'appelez ~, merci de corriger.", "Écrivez ~ dans le modèle pour afficher le nom.",
]

UNFILLED = UNFILLED + _blanked()
