"""Records whose wording no list of `residue` was drawn up from: what is residue, and look-alikes. They were written after the lists, in seven languages, and never used to change them."""

NAMES = ("Anna", "Bertil Berg", "Chloe", "Dmitri", "Eva")

#: Templates that five records fill with values, and what one record keeps instead.
TEMPLATES = (
    ("Hi {n}, thanks for joining our book club.", "Hi customer_name, thanks for joining our book club."),
    ("Bonjour {n}, votre colis numéro {k} est en route.", "Bonjour null, votre colis numéro 12 est en route."),
    ("Sehr geehrte Frau {n}, Ihr Termin ist am {k}. Mai.", "Sehr geehrte Frau undefined, Ihr Termin ist am 4. Mai."),
    ("Estimado {n}: su pedido {k} está listo.", "Estimado [object Object]: su pedido 4 está listo."),
    ("Gentile {n}, la sua fattura è pronta.", "Gentile {cliente}, la sua fattura è pronta."),
    ("Assigned to {n} by the night desk.", "Assigned to null by the night desk."),
    ("Geachte {n}, uw tafel voor {k} personen is gereserveerd.", "Geachte , uw tafel voor 4 personen is gereserveerd."),
    ("Reviewed by {n} before the harvest of {k} fields.", "Reviewed by FullName before the harvest of 3 fields."),
    ("The keys were handed to {n} at gate {k}.", "The keys were handed to  at gate 9."),
    ("Best wishes to {n} and the whole choir.", "Best wishes to RECIPIENT and the whole choir."),
)
ALONE = (
    "Write to {{ support.email }} if the lamp stays dark.", "Signed for [Company Name] in spring.", "Ask %FIRST_NAME% at the desk.", "Made by @@author@@ in the old mill.", "Your hosts: <insert names here>",
    "Lorem ipsum dolor sit amet, sed do eiusmod tempor.", "blah blah blah blah blah", "Your text goes here.", "TODO: write this section", "Dummy text for the brochure.",
    "Please enable JavaScript to see the map.", "Attiva JavaScript per continuare.", "Cookies are disabled in your browser.", "Verifica que no eres un robot.", "Enable cookies and reload.",
)
#: Pages that four records hold with other numbers.
PAGES = ("Pagina non trovata. Riferimento {k}", "Página não encontrada. Referência {k}", "Deze pagina is helaas verplaatst. Zaak {k}", "Страница не найдена. Код 40{k}", "This workspace link has expired, sorry. Ticket {k}.", "Diese Seite ist leider umgezogen. Vorgang {k}", "Oops, the file was removed. Incident {k}", "Accesso negato. Riprova tra {k} minuti.")
CLEAN = (
    "The form leaves the name null until it is saved.", "We render {{name}} in `templates/mail.html`.", "undefined behaviour is avoided in this module.", "Bump the version to 1.2.3", "Fix the 404 on the settings page", "Return null for an unknown owner.",
    "The page about moved goods was rewritten.", "Sorry for the delay, the review is done.", "const {name} = props;", "None of the guests was late.", "The titles are filled by the build.", "A cookie holds the session for a day.", "Scripts are required to pass the linter.", "Lorem is the name of our test server.", "The access log is denied to guests by design.",
    "La page d'accueil est traduite.", "Die Seite wurde neu gestaltet.", "El acceso al archivo es rápido.", "Il documento è stato aggiornato.", "Vertaal de pagina naar het Engels.",
)
REPEATED = ("Update the dependencies of step {k}", "Merge branch of ticket {k}", "Release notes of week {k}", "The service answered in {k} ms")


def records() -> list[tuple[int, str, bool]]:
    """(id, text, whether it is residue)."""
    out = [(t.format(n=n, k=3 + i), False) for t, _ in TEMPLATES for i, n in enumerate(NAMES)] + [(kept, True) for _, kept in TEMPLATES]
    out += [(t, True) for t in ALONE] + [(p.format(k=i), True) for p in PAGES for i in range(4)]
    out += [(t, False) for t in CLEAN] + [(t.format(k=i), False) for t in REPEATED for i in range(5)]
    return [(i, t, case) for i, (t, case) in enumerate(out)]
