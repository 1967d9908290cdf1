"""The small labelled table that the personal-data field is trained from.

Sentences in six languages, put together from the wording below, with marked places that are filled with invented values. A
place in braces is personal data ({name}, {email}, {phone}, {id}, {addr}); one in double angles is not (<<company>>, ...). The
wording is general and written for this table: no sentence is taken from a corpus that the field is used on.
The rows are (text, spans), spans being (start, end, kind).
"""

from __future__ import annotations

import random
import re

#: Sentences of loose words per language, for every filling of the table.
LOOSE = 90

KINDS = ("email", "phone", "id_number", "address", "name")

FIRST = "Anna Paul Maria Jonas Clara Peter Lena Marco Sofia Luca Emma Pierre Julie Carlos Elena Pablo Ines Jan Sanne Pieter Eva Tomas Ewa Piotr Olga Felix Nora Simon Laura David Irene Victor Alice Hugo Marta Robert Ella Oscar Helen George Mary Edith Frank Louise Zoe Ahmed Leila Yusuf Mei Ravi Otto Bianca Rosa Ulrich Wanda Karel Milan Greta Nils Silvia Martin Anton Bruno Chiara Daniel Dora Edgar Elise Emil Erik Esther Fabio Fiona Franz Gabriel Georg Gloria Hanna Heidi Henri Ida Igor Isabel Jakob Jasper Joana Johan Josef Judith Julian Katja Kevin Kira Lars Leon Lidia Linus Lotte Lucas Lukas Magda Manuel Marek Marie Matteo Max Mila Mona Nadine Natalia Nico Nina Noah Oliver Oskar Paola Patrick Petra Philipp Raul Rebecca Renata Rico Roberto Sara Sebastian Sergio Sonja Stefan Susanne Sven Teresa Theo Thomas Tim Ursula Valerie Vera Viktor Walter Werner William Xaver Yvonne Zofia".split()
ENDS = "holm sten beek brink stedt kranz mare velle hollow wiek vall soto quet nelli marsh dale bury ford ham ton field wood bridge meyer huber hagen rath horst wald thal mont court roux lier nard champ rez mez dez gues illo ales ado ero tini lli cci sco sso nti ani veld mans ink ema huis laar sson qvist gren dahl rud skov icki ecki ewski owski czuk ak ek ova berg mann stein feld hauser moor quist gaard vik croft combe ley worth shaw well rini etti ossi ando ella oni ard eau ette ois ier ville ez ano era illa uelo osto sma stra wijk broek dijk hof ski wicz czyk niak ov enko bauer kamp lund strom sen".split()
#: Invented first names are put together from these.
FIRST_STARTS = "A Be Ca Da E Fa Ge Ha I Ja Ka La Ma Na O Pa Qui Ra Sa Ta U Va Wi Xe Ya Ze Bri Cla Dor Fre Gre Hen Jo Kat Lo Mir Nor Per Ros Sil Tom Ul Ven Wal Zo Gui Ste Phi Cri An El".split()
FIRST_ENDS = "na ne lle tta ette ine ina eke je asz ek us as is io ro on an ian iel ard bert hild ique ita ela ija slav win fried old ric ald mund ndra zyna loma rta lia nia sia ko ka rien ster tin ton mas vin dia".split()

STARTS = "Al Bar Cor Dal Ester Fal Gron Hal Ister Jar Kel Lom Mar Nor Ostr Per Quil Ros Sal Tor Ulm Ver West Yar Zel Brand Cast Drum Fren Grim Hart Kran Lind Mont Pell Rauten Stern Thist Van Wett Ach Ell Och".split()
STREET = "Linden Ahorn Birken Schul Garten Kirch Mühlen Berg Wald Rosen Eichen Brunnen Hafen Markt Kastanien Tannen Holunder Lerchen".split()
CITY = "Hamburg Leipzig Ulm Graz Bristol Leeds Dublin Cork Lyon Lille Metz Nantes Sevilla Murcia Bilbao Bari Padova Torino Utrecht Breda Gent Porto".split()
SOFTWARE = "Kubernetes,Python,Excel,Node.js,C++,Spring Boot,Power BI,TCP/IP,Salesforce,Six Sigma,Terraform,React,Angular,Kafka,Docker,Jenkins,Linux,SAP,Word,Outlook,Photoshop,Git,Jira,Scrum,CI/CD,PL/SQL,C#,Go,Java,Ruby,Rust,Oracle,Hadoop,Tableau,Google Ads,SQL Server,Visual Studio,AutoCAD".split(",")
SYL = "ba be bo du fe ga go he ki ko la lo ma me mi na ni no pa pe po ra ri ro sa se si ta te ti tu va ve vi za zo tre kri plo bru sti dra".split()

#: Per language: the wording around personal data. Sentences are put together from it, see marked_patterns().
#: ask + who + reach; told (persons in sentences); pinned + number, in file and lives + address; where + address; close.
WORDS: dict[str, dict[str, list[str]]] = {
    "en": {
        "ask": ["Contact", "Contact person:", "Questions to", "Phone", "Call", "Write to", "Any doubts?", "Get in touch with", "Talk to", "Reach", "Speak with", "Mail your CV to", "Our recruiter is", "Ask for", "For details contact", "Applications go to", "In case of doubt ring", "Personnel office,", "Responsible:", "Enquiries:"],
        "reach": [" at {email}", " ({email})", ", {email}", " on {phone}", " via {phone} or {email}", ": {phone}, {email}", " <{email}>", ", telephone {phone}", ", mobile {phone}, {email}", " / {phone}"],
        "told": ["Our last clerk, {name}, moved on.", "The new lead, {name}, joined in <<year>>.", "As {name} says, every day counts.", "Like {name} once wrote: work needs light.", "{name} will train you, {name} will help.", "Approved: {name}", "Report to {name} in <<city>>.", "Sent by {name} <{email}> to {name} <{email}>", "Attention {name}, {addr_en}, <<city>>", "c/o {name}, {addr_en}", "Dial {phone} and ask for desk <<n>>.", "Use {email} for papers.", "Your mail to {email} should name the code <<ref>>.", "Files <<ref>>: {name}.", "Dossier <<ref>> of {name}, {id_en}.", "{name} runs the unit and {name} stands in for holidays.", "You will sit next to {name}.", "Our colleague {name} told us: the canteen is great.", "{name} retires in <<year>>, so we need you.", "Founded by {name} in <<year>>, we still own the place.", "In the words of {name}, every day is different.", "Introduced by {name}, reviewed by {name}.", "The board ({name}, {name}) approved the budget.", "Your predecessor {name} moved to <<city>>.", "We thank {name} for <<n>> good years.", "On behalf of {name}", "cc: {name}", "{name}, head of unit", "Your first weeks are planned by {name}."],
        "pinned": ["ID", "ID no.", "SSN", "NI number", "Document", "document number", "Personal ID", "Identification no.", "Passport", "ID card", "National insurance number", "Social security no.", "Identity document", "Tax number of the applicant:", "Applicant number in the register:", "Travel document"],
        "file": ["Minutes: {name}, {pin}, {lives} {addr}, cell {phone}.", "{name}, {pin}, {lives} {addr}.", "{name}, {pin}.", "{name}, {pin}, tel. {phone}.", "Applicant {name}, {pin}, home: {addr}, {phone}.", "{name} showed {pin} at the gate.", "For the contract: {name}, born <<year>>, {pin}, {addr}.", "Interviewed on <<date>>: {name} ({pin}), can be called on {phone}.", "{pin} belongs to {name}."],
        "where": ["Visit us at", "Our premises:", "The workshop stands at", "Postal address:", "Come to", "Send letters to <<company>>,", "Reception:", "Interviews take place in", "We moved to", "{name} lives at", "Directions: tram to"],
        "after": ["", ", <<city>>", ". Ring twice.", ", second floor.", " (entrance in the yard)", ", next to the park."],
        "close": ["Sincerely", "Warm regards", "Yours faithfully", "Thanks and see you soon", "All the best", "With regards from <<city>>"],
        "lives": ["lives at", "resident at", "of", "residing at", "home address", "living in"],
    },
    "de": {
        "ask": ["Kontakt:", "Kontaktperson:", "Fragen an", "Auskunft:", "Fragen? Ruf", "Antworten gibt", "Melde dich bei", "Wende dich an", "Rückfragen an", "Ansprechperson ist", "Bewirb dich bei", "Auskunft gibt", "Ruf einfach an:", "Schick deinen Lebenslauf an", "Zuständig:", "Personalabteilung,", "Dein Kontakt:", "Sprich mit"],
        "reach": [" ({email})", ", {email}", " unter {phone}", ", Telefon {phone}, E-Mail {email}", ": {phone}", " oder {email}", ", mobil {phone}", ", Durchwahl {phone}, {email}", " per Mail: {email}"],
        "told": ["Unsere letzte Kraft, {name}, ist gegangen.", "Die neue Leitung, {name}, kam <<year>>.", "Wie {name} sagt: jeder Tag zählt.", "Eingelernt wirst du durch {name}, später hilft {name}.", "Dein Chef heißt {name}.", "Genehmigt: {name}", "z. H. {name}, {addr_de}, <<city>>", "c/o {name}, {addr_de}", "Telefon: {phone}", "Fon {phone}", "Nutze {email} für Unterlagen.", "Rückruf erbeten: {name}, {phone}.", "Steuer-ID {id_de} ist bekannt, anrufen bei {name}, {phone}.", "Nicht weit vom Rathaus: {addr_de}.", "Akte <<ref>>: {name}, {id_de}.", "{name} führt die Abteilung, {name} vertritt im Urlaub.", "Neben dir sitzt {name}.", "Unser Kollege {name} sagt: die Kantine ist prima.", "{name} geht <<year>> in Rente, deshalb suchen wir dich.", "Gegründet von {name} im Jahr <<year>>.", "Der Vorstand ({name}, {name}) hat das Budget genehmigt.", "Deine Vorgängerin {name} ist nach <<city>> gezogen.", "Im Auftrag von {name}", "{name}, Leitung Personal", "Wir danken {name} für <<n>> gute Jahre.", "Geprüft von {name} am <<date>>.", "Die ersten Wochen plant {name}."],
        "pinned": ["Ausweis", "Pass", "Perso", "Steuer-ID", "St.-Nr.", "Ausweis-Nr.", "ID", "SV-Nummer", "Personalausweis", "Reisepass Nr.", "Steuernummer der Person:", "Steueridentifikationsnummer", "Ausweisnummer", "Sozialversicherungsnummer", "Identifikationsnummer"],
        "file": ["Notiz: {name}, {pin}, {lives} {addr}, Handy {phone}.", "{name}, {pin}, {lives} {addr}.", "{name}, {pin}.", "{name}, {pin}, Tel. {phone}.", "Bewerber {name}, {pin}, Wohnung: {addr}, {phone}.", "{name} hat {pin} am Tor gezeigt.", "Für den Vertrag: {name}, geboren <<year>>, {pin}, {addr}.", "Gespräch am <<date>> mit {name} ({pin}), erreichbar unter {phone}.", "{pin} gehört zu {name}."],
        "where": ["Besuch uns:", "Unsere Räume liegen in der", "Die Werkstatt steht hier:", "Postanschrift:", "Komm vorbei,", "Briefe an <<company>>,", "Empfang:", "Gespräche finden statt:", "Wir sind umgezogen,", "{name} wohnt", "Sitz der Firma:"],
        "after": ["", ", <<city>>", ". Bitte zweimal klingeln.", ", zweiter Stock.", " (Eingang im Hof)", ", neben dem Park."],
        "close": ["Freundliche Grüße", "Beste Grüße", "Herzliche Grüße aus <<city>>", "Bis bald", "Hochachtungsvoll", "Danke und Gruß"],
        "lives": ["wohnhaft in", "wohnhaft", "wohnt", "Adresse", "zu Hause in", "gemeldet"],
    },
    "es": {
        "ask": ["Contacto:", "Persona de contacto:", "Preguntas a", "Llama a", "Envía los papeles a", "Escribe a", "Habla con", "Pregunta por", "Manda tu historial a", "Responsable:", "Recursos humanos,", "Para más detalles llama a", "Tu persona de enlace es", "Dirígete a", "Información:"],
        "reach": [" ({email})", ", {email}", " en el {phone}", ", teléfono {phone}, correo {email}", ": {phone}", " o {email}", ", móvil {phone}", " por correo: {email}"],
        "told": ["Nuestra última empleada, {name}, se marchó.", "La nueva jefa, {name}, llegó en <<year>>.", "Como dice {name}: cada día cuenta.", "Te forma {name}, te ayuda {name}.", "A la atención de {name}, {addr_es}, <<city>>", "Tel. {phone}", "Tfno. {phone}", "Usa {email} para los papeles.", "Estamos cerca: {addr_es}, <<city>>.", "Expediente <<ref>>: {name}, {id_es}, tel. {phone}.", "{name} dirige la unidad y {name} cubre las vacaciones.", "A tu lado trabaja {name}.", "Nuestra compañera {name} lo dice así: se come bien.", "{name} se jubila en <<year>> y por eso te buscamos.", "Fundada por {name} en <<year>>.", "El consejo ({name}, {name}) aprobó el presupuesto.", "Damos las gracias a {name} por <<n>> buenos años.", "En nombre de {name}", "{name}, jefa de personal", "Revisado por {name} el <<date>>."],
        "pinned": ["DNI", "NIF", "D.N.I.", "Documento", "Pasaporte n.º", "ID", "Pasaporte", "Documento nacional", "Número de identidad", "NIE", "Carné de identidad", "Identificación"],
        "file": ["Nota: {name}, {pin}, {lives} {addr}, móvil {phone}.", "{name}, {pin}, {lives} {addr}.", "{name}, {pin}.", "{name}, {pin}, tel. {phone}.", "Candidata {name}, {pin}, domicilio: {addr}, {phone}.", "{name} enseñó {pin} en la puerta.", "Para el contrato: {name}, nacida en <<year>>, {pin}, {addr}.", "Entrevista del <<date>> con {name} ({pin}), llamar al {phone}.", "{pin} pertenece a {name}."],
        "where": ["Visítanos en", "Nuestro local:", "El taller está en", "Dirección postal:", "Ven a", "Cartas a <<company>>,", "Recepción:", "Las entrevistas son en", "Nos mudamos a", "{name} vive en", "Sede:"],
        "after": ["", ", <<city>>", ". Llame dos veces.", ", segundo piso.", " (entrada por el patio)", ", junto al parque."],
        "close": ["Atentamente", "Saludos cordiales", "Gracias y hasta pronto", "Reciba un cordial saludo", "Saludos desde <<city>>"],
        "lives": ["domiciliada en", "residente en", "vive en", "domicilio", "con dirección en"],
    },
    "fr": {
        "ask": ["Contact :", "Personne à contacter :", "Questions à", "Appelez", "Envoyez vos papiers à", "Écrivez à", "Parlez avec", "Demandez", "Adressez votre candidature à", "Responsable :", "Ressources humaines,", "Pour en savoir plus, appelez", "Votre interlocuteur est", "Renseignements :", "Joindre"],
        "reach": [" ({email})", ", {email}", " au {phone}", ", téléphone {phone}, courriel {email}", " : {phone}", " ou {email}", ", portable {phone}", " par courriel : {email}"],
        "told": ["Notre dernière employée, {name}, est partie.", "La nouvelle chef, {name}, est arrivée en <<year>>.", "Comme dit {name} : chaque jour compte.", "{name} vous forme, {name} vous aide.", "À l'attention de {name}, {addr_fr}, <<city>>", "Tél. {phone}", "Tél. : {phone}", "Utilisez {email} pour les papiers.", "Nous sommes tout près : {addr_fr}, <<city>>.", "Dossier <<ref>> : {name}, {id_fr}, joint au {phone}.", "{name} dirige l'unité et {name} assure l'intérim.", "Vous serez assis à côté de {name}.", "Notre collègue {name} le dit : la cantine est bonne.", "{name} part à la retraite en <<year>>.", "Fondée par {name} en <<year>>.", "Le conseil ({name}, {name}) a voté le budget.", "Merci à {name} pour <<n>> belles années.", "Au nom de {name}", "{name}, chef du personnel", "Relu par {name} le <<date>>."],
        "pinned": ["N° de sécurité sociale", "Sécurité sociale", "NIR", "CNI", "n° de passeport", "Pièce d'identité", "ID", "Passeport", "Carte d'identité", "Numéro d'assuré", "Numéro de sécu", "Immatriculation de la personne :", "Identifiant national"],
        "file": ["Note : {name}, {pin}, {lives} {addr}, portable {phone}.", "{name}, {pin}, {lives} {addr}.", "{name}, {pin}.", "{name}, {pin}, tél. {phone}.", "Candidate {name}, {pin}, domicile : {addr}, {phone}.", "{name} a montré {pin} à l'accueil.", "Pour le contrat : {name}, née en <<year>>, {pin}, {addr}.", "Entretien du <<date>> avec {name} ({pin}), appeler le {phone}.", "{pin} est celui de {name}."],
        "where": ["Passez nous voir :", "Nos locaux :", "L'atelier se trouve", "Adresse postale :", "Rendez-vous", "Courrier à <<company>>,", "Accueil :", "Les entretiens ont lieu", "Nous avons déménagé,", "{name} habite", "Siège :"],
        "after": ["", ", <<city>>", ". Sonnez deux fois.", ", deuxième étage.", " (entrée par la cour)", ", près du parc."],
        "close": ["Bien à vous", "Salutations distinguées", "Merci et à bientôt", "Sincères salutations", "Bonne journée"],
        "lives": ["domiciliée", "demeurant", "habitant", "résidant", "adresse"],
    },
    "it": {
        "ask": ["Contatto:", "Persona da contattare:", "Domande a", "Chiama", "Spedisci le carte a", "Scrivi a", "Parla con", "Chiedi di", "Manda la candidatura a", "Responsabile:", "Ufficio personale,", "Per saperne di più chiama", "La tua persona di riferimento è", "Informazioni:", "Rivolgiti a"],
        "reach": [" ({email})", ", {email}", " al {phone}", ", telefono {phone}, posta {email}", ": {phone}", " o {email}", ", cellulare {phone}", " per posta elettronica: {email}"],
        "told": ["La nostra ultima impiegata, {name}, è andata via.", "La nuova capa, {name}, è arrivata nel <<year>>.", "Come dice {name}: ogni giorno conta.", "{name} ti forma, {name} ti aiuta.", "Alla cortese attenzione di {name}, {addr_it}, <<city>>", "Tel. {phone}", "Usa {email} per le carte.", "Siamo vicino: {addr_it}, <<city>>.", "La sede sta in {addr_it}, <<city>>.", "Pratica <<ref>>: {name}, {id_it}, tel. {phone}.", "{name} guida il reparto e {name} copre le ferie.", "Accanto a te siede {name}.", "La nostra collega {name} dice: si mangia bene.", "{name} va in pensione nel <<year>>.", "Fondata da {name} nel <<year>>.", "Il consiglio ({name}, {name}) ha approvato la spesa.", "Ringraziamo {name} per <<n>> buoni anni.", "Per conto di {name}", "{name}, capo del personale", "Riletto da {name} il <<date>>."],
        "pinned": ["Documento", "C.F.", "CF", "Carta n.", "documento d'identità", "ID", "Passaporto", "Carta d'identità", "Codice fiscale", "Tessera personale", "Numero del passaporto", "Codice della persona:"],
        "file": ["Nota: {name}, {pin}, {lives} {addr}, cell. {phone}.", "{name}, {pin}, {lives} {addr}.", "{name}, {pin}.", "{name}, {pin}, tel. {phone}.", "Candidata {name}, {pin}, domicilio: {addr}, {phone}.", "{name} ha mostrato {pin} al cancello.", "Per il contratto: {name}, nata nel <<year>>, {pin}, {addr}.", "Colloquio del <<date>> con {name} ({pin}), chiamare {phone}.", "{pin} è di {name}."],
        "where": ["Vieni a trovarci:", "I nostri locali:", "L'officina sta in", "Indirizzo postale:", "Passa da noi,", "Lettere a <<company>>,", "Portineria:", "I colloqui si tengono in", "Ci siamo trasferiti in", "{name} abita in", "Sede:"],
        "after": ["", ", <<city>>", ". Suonare due volte.", ", secondo piano.", " (ingresso dal cortile)", ", vicino al parco."],
        "close": ["Distinti saluti", "Un cordiale saluto", "Grazie e a presto", "Buona giornata", "Saluti da <<city>>"],
        "lives": ["residente in", "domiciliata in", "vive in", "con indirizzo in", "abitante in"],
    },
    "nl": {
        "ask": ["Contact:", "Contactpersoon:", "Vraag het", "Bel", "Stuur je papieren naar", "Neem contact op met", "Praat met", "Vraag naar", "Mail je cv naar", "Verantwoordelijk:", "Personeelszaken,", "Meer weten? Bel met", "Jouw aanspreekpunt is", "Inlichtingen:", "Solliciteren kan bij"],
        "reach": [" ({email})", ", {email}", " op {phone}", ", telefoon {phone}, e-mail {email}", ": {phone}", " of {email}", ", mobiel {phone}", " per mail: {email}"],
        "told": ["Onze laatste kracht, {name}, is weg.", "De nieuwe chef, {name}, kwam in <<year>>.", "Zoals {name} zegt: elke dag telt.", "{name} leert je in, {name} helpt je.", "Ter attentie van {name}, {addr_nl}, <<city>>", "Tel. {phone}", "Telefoon: {phone}", "Gebruik {email} voor papieren.", "Wij zitten vlakbij: {addr_nl}, <<city>>.", "Dossier <<ref>>: {name}, {id_nl}, tel. {phone}.", "{name} leidt de afdeling en {name} vervangt in de vakantie.", "Naast je zit {name}.", "Onze collega {name} zegt: de kantine is goed.", "{name} gaat in <<year>> met pensioen.", "Opgericht door {name} in <<year>>.", "Het bestuur ({name}, {name}) keurde het budget goed.", "We danken {name} voor <<n>> goede jaren.", "Namens {name}", "{name}, hoofd personeel", "Nagekeken door {name} op <<date>>."],
        "pinned": ["BSN", "ID-kaart", "ID", "Paspoortnummer", "Document", "rijbewijs", "Paspoort", "Identiteitskaart", "Burgerservicenummer", "Sofinummer", "Persoonsnummer", "Nummer van het document:"],
        "file": ["Notulen: {name}, {pin}, {lives} {addr}, mobiel {phone}.", "{name}, {pin}, {lives} {addr}.", "{name}, {pin}.", "{name}, {pin}, tel. {phone}.", "Kandidaat {name}, {pin}, thuis: {addr}, {phone}.", "{name} liet {pin} zien bij de poort.", "Voor het contract: {name}, geboren in <<year>>, {pin}, {addr}.", "Gesprek op <<date>> met {name} ({pin}), te bellen op {phone}.", "{pin} is van {name}."],
        "where": ["Kom langs:", "Onze ruimtes:", "De werkplaats staat aan de", "Postadres:", "Kom naar", "Brieven aan <<company>>,", "Receptie:", "Gesprekken zijn op de", "Wij zijn verhuisd naar", "{name} woont aan de", "Hoofdkantoor:"],
        "after": ["", ", <<city>>", ". Twee keer bellen.", ", tweede etage.", " (ingang op de binnenplaats)", ", naast het park."],
        "close": ["Hartelijke groet", "Groeten", "Dank en tot gauw", "Hoogachtend", "Groeten uit <<city>>"],
        "lives": ["woonachtig", "wonend", "woont", "adres", "wonende te"],
    },
}

#: Per language: sentences without personal data (figures, references, dates, companies, products, places) and headings.
PLAIN: dict[str, list[str]] = {
    "en": [
        "Founded in <<year>>, <<company>> employs <<n>> people.", "<<company>> now hires a <<job>>.", "We need a <<job>> in <<city>> from <<date>>.", "Reference number <<ref>> must be on the letter.", "Job code: <<ref>>", "Vacancy <<ref>>, open until <<date>>.", "Pay: <<money>> euros a year plus bonus.", "Our stack is <<product>>, <<product>> and <<product>>.",
        "We run <<product>> <<n>>.<<n>> on <<n>> servers.", "Experience in <<product>> for <<n>> years is required.", "Working time is <<n>> hours a week, Monday to Friday.", "Clients of <<company>> include <<company>> and <<company>>.", "Who we are", "Duties", "Requirements", "Benefits", "Budget <<money>>, team size <<n>>, start <<date>>.",
        "Each spring the old mill in <<city>> opens <<n>> doors for curious visitors and careful bakers.", "Strong tea, slow trains and <<n>> empty chairs make a quiet office.", "A <<job>> at <<company>> trains apprentices, repairs pumps and writes reports about <<product>>.", "Why does a sailor count <<n>> ropes before breakfast?", "Neither rain nor wind stops a good postman, says an old book.", "Help clients use <<product>>, sort tickets, test <<product>>.",
        "Pumps, valves and <<n>> pipes: who labels them?", "We like clear words, short meetings and fresh bread.", "Deadline <<date>>", "Level <<n>> of <<n>>", "Section <<n>>: market, growth and risks in health, energy and transport.",
        "Do you enjoy moving boxes, sorting mail and calming guests?", "The post is open to beginners as well as to people with long practice.", "You take part in meetings, write minutes and keep lists.", "Travel to <<city>> happens <<n>> times a year.", "You report to the head of sales and work closely with finance.", "The canteen serves soup, salad and fruit every day.", "As <<job>> you serve shops, schools and hospitals.", "Knowledge of <<product>> or REST, SQL and XML is a plus.", "A driving licence would be useful but is not a must.", "You are patient, friendly and good with numbers.", "Overtime is paid or taken off later.", "Do you wish to grow with us and form the future of retail?", "Salary band between <<money>> and <<money>> euros.",
        "Show us what you can do.", "Every week a baker brings rolls.", "A letter of one page is enough.", "Our values", "The team of <<n>> cooks, cleaners and clerks", "Clerks and porters rarely meet.", "Please state the code <<ref>>.", "Before noon the yard is loud; after noon a ladder, a rope and <<n>> boxes stand there.", "As a Ski Teacher, Tour Guide or <<job>> you travel a lot.", "OLD LADDERS AND <<n>> ROPES HANG NEAR THE GATE.",
    ],
    "de": [
        "<<company>>, gegründet <<year>>, beschäftigt <<n>> Leute.", "<<company>> stellt ein: <<job>>.", "Wir brauchen ab <<date>> eine Person als <<job>> in <<city>>.", "Die Referenznummer <<ref>> gehört auf das Schreiben.", "Stellencode: <<ref>>", "Angebot <<ref>>, offen bis <<date>>.", "Entgelt: <<money>> Euro im Jahr plus Zulage.", "Wir nutzen <<product>>, <<product>> und <<product>>.",
        "Bei uns läuft <<product>> <<n>>.<<n>> auf <<n>> Rechnern.", "Verlangt werden <<n>> Jahre Praxis in <<product>>.", "Die Arbeitszeit beträgt <<n>> Stunden, Montag bis Freitag.", "Zu den Kunden von <<company>> zählt <<company>>.", "Wer wir sind", "Aufgaben", "Anforderungen", "Vorteile", "Etat <<money>>, Team <<n>>, Beginn <<date>>.",
        "Jeden Frühling öffnet die alte Mühle in <<city>> <<n>> Türen für neugierige Gäste und fleißige Bäcker.", "Starker Tee, langsame Züge und <<n>> leere Stühle machen ein ruhiges Büro.", "Als <<job>> reparierst du Pumpen, schreibst Berichte und prüfst Kessel mit <<product>>.", "Warum zählt der Matrose <<n>> Seile vor dem Frühstück?", "Weder Regen noch Wind halten den Briefträger auf, steht in einem Buch.", "Hilf Kunden bei <<product>>, sortiere Anfragen, teste <<product>>.",
        "Pumpen, Ventile sowie <<n>> Rohre: wer beschriftet sie?", "Klare Worte, kurze Treffen und frisches Brot mögen wir.", "Frist <<date>>", "Stufe <<n>> von <<n>>", "Abschnitt <<n>>: Markt, Wachstum und Risiken in Gesundheit, Energie und Verkehr.",
        "Hast du Freude daran, Kisten zu bewegen, Post zu ordnen und Gäste zu beruhigen?", "Die Stelle steht Anfängern ebenso offen wie Leuten mit langer Praxis.", "Du nimmst an Sitzungen teil, schreibst Protokolle und führst Listen.", "Reisen nach <<city>> gibt es <<n>> Mal im Jahr.", "Du arbeitest eng mit Vertrieb und Finanzen zusammen.", "Die Kantine bietet täglich Suppe, Salat und Obst.", "Kenntnisse in <<product>> oder REST, SQL und XML sind ein Vorteil.", "Ein Führerschein wäre nützlich, ist aber keine Pflicht.", "Du bist geduldig, freundlich und gut mit Zahlen.", "Überstunden werden bezahlt oder später frei gegeben.", "Willst du mit uns wachsen und die Zukunft des Handels gestalten?", "Gehaltsband zwischen <<money>> und <<money>> Euro.",
        "Zeig uns, was du kannst.", "Jede Woche bringt ein Bäcker Brötchen.", "Ein Brief von einer Seite reicht.", "Unsere Werte", "Köche, Putzkräfte und <<n>> Schreiber im Bereich Verwaltung.", "Bitte nenne den Code <<ref>>.", "Vor dem Mittag ist der Hof laut; danach stehen eine Leiter, ein Seil und <<n>> Kisten da.", "Im Keller <<n>> liegt die Werkstatt.", "Der Bereich Forschung und der Bereich Einkauf wachsen.", "Eine Pumpe, <<n>> Kessel und eine Treppe im Hof",
    ],
    "es": [
        "<<company>>, creada en <<year>>, emplea a <<n>> personas.", "<<company>> contrata: <<job>>.", "Necesitamos un <<job>> en <<city>> desde el <<date>>.", "El número <<ref>> debe figurar en la carta.", "Código de la oferta: <<ref>>", "Oferta <<ref>>, abierta hasta el <<date>>.", "Salario: <<money>> euros más prima.", "Usamos <<product>>, <<product>> y <<product>>.",
        "Aquí corre <<product>> <<n>>.<<n>> en <<n>> máquinas.", "Se piden <<n>> años de práctica en <<product>>.", "La jornada es de <<n>> horas, de lunes a viernes.", "Entre los clientes de <<company>> está <<company>>.", "Quiénes somos", "Funciones", "Requisitos", "Ventajas",
        "Cada primavera el viejo molino de <<city>> abre <<n>> puertas a los curiosos.", "Té fuerte, trenes lentos y <<n>> sillas vacías.", "Ayuda a los clientes con <<product>> y prueba <<product>>.", "Plazo <<date>>", "Nos gustan las reuniones cortas y el pan fresco.",
        "¿Te gusta mover cajas, ordenar el correo y calmar a los huéspedes?", "El puesto está abierto a principiantes y a personas con larga práctica.", "Participas en reuniones, escribes actas y llevas listas.", "Se viaja a <<city>> <<n>> veces al año.", "Para nuestra tienda de <<city>> queremos contratar pronto a un <<job>>.", "El comedor sirve sopa, ensalada y fruta cada día.", "Se valora saber <<product>> o REST, SQL y XML.", "El permiso de conducir ayuda pero no es obligatorio.", "Eres paciente, amable y bueno con los números.", "Las horas extra se pagan o se descansan.", "Banda salarial entre <<money>> y <<money>> euros.",
        "Muéstranos lo que sabes.", "Cada semana un panadero trae bollos.", "Una carta de una página basta.", "Nuestros valores", "Los cocineros y <<n>> porteros del equipo", "Por favor indica el código <<ref>>.", "Para el taller de <<city>> hacen falta <<n>> cajas.", "Tus ventajas", "El salario sube cada año.", "Aprendes rápido y lo explicas bien.",
    ],
    "fr": [
        "<<company>>, créée en <<year>>, emploie <<n>> personnes.", "<<company>> embauche : <<job>>.", "Il nous faut un <<job>> à <<city>> dès le <<date>>.", "Le numéro <<ref>> doit figurer sur la lettre.", "Code de l'offre : <<ref>>", "Offre <<ref>>, ouverte jusqu'au <<date>>.", "Rémunération : <<money>> euros plus prime.", "Nous utilisons <<product>>, <<product>> et <<product>>.",
        "Ici tourne <<product>> <<n>>.<<n>> sur <<n>> machines.", "On demande <<n>> ans de pratique de <<product>>.", "Le temps de travail est de <<n>> heures, du lundi au vendredi.", "Parmi les clients de <<company>> figure <<company>>.", "Qui sommes-nous", "Tâches", "Exigences", "Avantages",
        "Chaque printemps le vieux moulin de <<city>> ouvre <<n>> portes aux curieux.", "Thé fort, trains lents et <<n>> chaises vides.", "Aidez les clients avec <<product>> et testez <<product>>.", "Date limite <<date>>", "Nous aimons les réunions courtes et le pain frais.",
        "Aimez-vous déplacer des cartons, trier le courrier et rassurer les clients ?", "Le poste est ouvert aux débutants comme aux personnes expérimentées.", "Vous participez aux réunions, rédigez les comptes rendus et tenez les listes.", "On voyage à <<city>> <<n>> fois par an.", "Pour notre boutique de <<city>> nous voulons recruter vite un <<job>>.", "La cantine sert soupe, salade et fruits chaque jour.", "Connaître <<product>> ou REST, SQL et XML est un plus.", "Le permis de conduire aide mais n'est pas exigé.", "Vous êtes patient, aimable et à l'aise avec les chiffres.", "Les heures supplémentaires sont payées.", "Fourchette entre <<money>> et <<money>> euros.",
        "Montrez-nous ce que vous savez faire.", "Chaque semaine un boulanger apporte du pain.", "Une lettre d'une page suffit.", "Nos valeurs", "Les cuisiniers et <<n>> portiers de l'équipe", "Veuillez citer le code <<ref>>.", "Pour l'atelier de <<city>> il faut <<n>> caisses.", "Vos avantages", "Le secteur public et le secteur privé embauchent.", "Vous apprenez vite et vous expliquez bien.",
    ],
    "it": [
        "<<company>>, nata nel <<year>>, impiega <<n>> persone.", "<<company>> assume: <<job>>.", "Ci serve un <<job>> a <<city>> dal <<date>>.", "Il numero <<ref>> deve stare sulla lettera.", "Codice dell'offerta: <<ref>>", "Offerta <<ref>>, aperta fino al <<date>>.", "Paga: <<money>> euro più premio.", "Usiamo <<product>>, <<product>> e <<product>>.",
        "Qui gira <<product>> <<n>>.<<n>> su <<n>> macchine.", "Si chiedono <<n>> anni di pratica con <<product>>.", "L'orario è di <<n>> ore, da lunedì a venerdì.", "Tra i clienti di <<company>> c'è <<company>>.", "Chi siamo", "Mansioni", "Requisiti", "Vantaggi",
        "Ogni primavera il vecchio mulino di <<city>> apre <<n>> porte ai curiosi.", "Tè forte, treni lenti e <<n>> sedie vuote.", "Aiuta i clienti con <<product>> e prova <<product>>.", "Scadenza <<date>>", "Ci piacciono le riunioni brevi e il pane fresco.",
        "Ti piace spostare scatole, ordinare la posta e calmare gli ospiti?", "Il posto è aperto a chi comincia e a chi ha lunga pratica.", "Partecipi alle riunioni, scrivi i verbali e tieni gli elenchi.", "Si viaggia a <<city>> <<n>> volte all'anno.", "Per il nostro negozio di <<city>> vogliamo assumere presto un <<job>>.", "La mensa offre zuppa, insalata e frutta ogni giorno.", "Conoscere <<product>> o REST, SQL e XML è un vantaggio.", "La patente aiuta ma non è un obbligo.", "Sei paziente, gentile e bravo con i numeri.", "Lo straordinario è pagato.", "Fascia tra <<money>> e <<money>> euro.",
        "Mostraci quello che sai fare.", "Ogni settimana un fornaio porta il pane.", "Una lettera di una pagina basta.", "I nostri valori", "I cuochi e <<n>> portieri della squadra di <<city>>", "Si prega di citare il codice <<ref>>.", "Per l'officina di <<city>> servono <<n>> casse.", "I tuoi vantaggi", "Lo stipendio cresce ogni anno.", "Il settore pubblico di <<city>> assume.", "Ti occupi di ordini a giorni alterni.", "Una patente serve, ma non subito.",
    ],
    "nl": [
        "<<company>>, begonnen in <<year>>, heeft <<n>> mensen in dienst.", "<<company>> neemt aan: <<job>>.", "Wij hebben vanaf <<date>> een <<job>> nodig in <<city>>.", "Nummer <<ref>> moet op de brief staan.", "Code van de vacature: <<ref>>", "Vacature <<ref>>, open tot <<date>>.", "Loon: <<money>> euro plus toeslag.", "Wij gebruiken <<product>>, <<product>> en <<product>>.",
        "Hier draait <<product>> <<n>>.<<n>> op <<n>> machines.", "Gevraagd: <<n>> jaar praktijk met <<product>>.", "De werktijd is <<n>> uur, maandag tot vrijdag.", "Tot de klanten van <<company>> hoort <<company>>.", "Wie wij zijn", "Werkzaamheden", "Eisen", "Voordelen",
        "Elk voorjaar opent de oude molen in <<city>> <<n>> deuren voor nieuwsgierige gasten.", "Sterke thee, trage treinen en <<n>> lege stoelen.", "Help klanten met <<product>> en test <<product>>.", "Sluiting <<date>>", "Wij houden van korte vergaderingen en vers brood.",
        "Vind je het leuk om dozen te verplaatsen, post te sorteren en gasten te kalmeren?", "De functie staat open voor beginners en voor mensen met lange praktijk.", "Je neemt deel aan vergaderingen, schrijft verslagen en houdt lijsten bij.", "Er wordt <<n>> keer per jaar naar <<city>> gereisd.", "Voor onze winkel in <<city>> willen wij snel een <<job>> aannemen.", "De kantine biedt elke dag soep, salade en fruit.", "Kennis van <<product>> of REST, SQL en XML is een voordeel.", "Een rijbewijs helpt maar hoeft niet.", "Je bent geduldig, vriendelijk en goed met cijfers.", "Overuren worden betaald.", "Schaal tussen <<money>> en <<money>> euro.",
        "Laat zien wat je kunt.", "Elke week brengt een bakker brood.", "Een brief van een pagina is genoeg.", "Onze waarden", "De koks en <<n>> portiers van de ploeg", "Noem de code <<ref>> in je brief.", "Voor de werkplaats in <<city>> zijn <<n>> kisten nodig.", "Jouw voordelen", "De sector onderwijs en de sector zorg groeien.", "Je leert snel en legt het goed uit.", "Geef het nummer <<ref>> op.",
    ],
}

TITLES = {
    "title_en": ["Ms", "Mr", "Mrs", "Dr.", "Prof."], "title_de": ["Frau", "Herr", "Herrn", "Frau Dr.", "Herrn Dr.", "Frau Prof."], "title_es": ["Sr.", "Sra.", "don", "doña", "D."],
    "title_fr": ["Madame", "Monsieur", "M.", "Mme"], "title_it": ["Sig.", "Sig.ra", "dott.", "Dott.ssa"], "title_nl": ["de heer", "mevrouw", "dhr.", "mw."],
}


class Filler:
    """Invented values for the places of the sentences."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def pick(self, xs):
        return self.r.choice(xs)

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def caps(self, n: int) -> str:
        return "".join(self.r.choice("ABCDEFGHJKLMNPRTVXYZ") for _ in range(n))

    def word(self, a: int = 2, b: int = 4) -> str:
        return "".join(self.pick(SYL) for _ in range(self.r.randint(a, b)))

    def first(self) -> str:
        return self.pick(FIRST) if self.r.random() < 0.5 else self.pick(FIRST_STARTS) + self.pick(FIRST_ENDS)

    def surname(self) -> str:
        s = self.pick(STARTS) + self.pick(ENDS) if self.r.random() < 0.85 else self.word(2, 4).capitalize() + self.pick(ENDS)
        if self.r.random() < 0.15:
            s = s.replace("o", self.pick("öóø"), 1).replace("e", self.pick("éèë"), 1)
        return s

    def last(self) -> str:
        x = self.r.random()
        s = self.surname()
        if x < 0.05:
            s = self.pick(["Van", "De", "Von", "Di"]) + " " + s
        elif x < 0.13:
            s = s + "-" + self.surname()
        return s.upper() if self.r.random() < 0.1 else s

    def name(self) -> str:
        x, f, l = self.r.random(), self.first(), self.last()
        if x < 0.14:
            f = f + "-" + self.first()
        elif x < 0.28:
            f = f + " " + self.caps(1) + "."
        elif x < 0.36:
            f = f[0] + "."
        n = f"{l}, {f}" if self.r.random() < 0.18 else f"{f} {l}"
        y = self.r.random()
        return n.upper() if y < 0.08 else n.lower() if y < 0.15 else n

    def email(self) -> str:
        f, l = self.first().lower(), re.sub(r"[^a-z]", "", self.surname().lower()) or "abc"
        local = self.pick(["jobs", "bewerbung", "info", "careers." + l[:3], "hr-" + f, f + "+cv", f + "." + l, f + "_" + l, f[0] + l, l, f + "." + l, f + "_" + l])
        domain = self.pick(["", "", "", "hr.", "mail.", "post."]) + (self.word(2, 3) if self.r.random() < 0.8 else l) + self.pick(["", "-jobs", "-group"])
        tld = self.pick(["example", "example", "example", "com", "de", "org", "net"])
        x = self.r.random()
        if x < 0.68:
            e = f"{local}@{domain}.{tld}"
        elif x < 0.76:
            e = f"{local} @ {domain}.{tld}"
        elif x < 0.85:
            e = f"{local}[at]{domain.replace('.', '[dot]')}[dot]{tld}"
        elif x < 0.92:
            e = f"{local} (at) {domain}.{tld}"
        else:
            return f"{local} AT {domain.replace('.', ' DOT ')} DOT {tld}"
        return e.upper() if self.r.random() < 0.1 else e

    def phone(self) -> str:
        d = self.digits
        return self.pick([
            lambda: f"+44 20 79{d(2)} {d(4)}", lambda: f"020 79{d(2)} {d(4)}", lambda: f"(020) 79{d(2)}-{d(4)}", lambda: f"0044 20 79{d(6)}", lambda: f"+1 ({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"+353 20 915 {d(4)}",
            lambda: f"030/{d(5)} {d(3)}", lambda: f"(030) {d(2)} {d(3)} {d(3)}", lambda: f"+49 (0)30 {d(5)}-{d(3)}", lambda: f"+49 176 {d(8)}", lambda: f"0176-{d(5)} {d(3)}", lambda: f"0049 30 {d(8)}",
            lambda: f"+34 900 {d(3)} {d(3)}", lambda: f"900 {d(3)} {d(3)}", lambda: f"(+34) 600-{d(3)}-{d(3)}", lambda: f"600{d(6)}",
            lambda: f"+33 1 99 00 {d(2)} {d(2)}", lambda: f"01 99 00 {d(2)} {d(2)}", lambda: f"01.99.00.{d(2)}.{d(2)}", lambda: f"0033 (0)1 99 00 {d(2)} {d(2)}", lambda: f"019900{d(4)}",
            lambda: f"+39 055 {d(4)} {d(3)}", lambda: f"055-{d(7)}", lambda: f"055/{d(4)} {d(3)}",
            lambda: f"+31 (0)85 {d(4)} {d(3)}", lambda: f"085-{d(7)}", lambda: f"0031 85 {d(4)} {d(3)}", lambda: f"06 {d(8)}",
        ])()

    def id(self, lang: str) -> str:
        d, c = self.digits, self.caps
        forms = {
            "en": [lambda: f"QQ{d(6)}{c(1)}", lambda: f"QQ {d(2)} {d(2)} {d(2)} {c(1)}", lambda: f"{c(2)}{d(7)}", lambda: f"P<{d(7)}", lambda: f"000-{d(2)}-{d(4)}"],
            "de": [lambda: d(11), lambda: f"{d(2)} {d(3)} {d(3)} {d(3)}", lambda: f"L{d(2)}{c(2)}{d(2)}{c(1)}{d(2)}", lambda: f"C{c(2)}{d(3)}{c(2)}{d(1)}"],
            "es": [lambda: f"{d(8)}{c(1)}", lambda: f"{d(8)}-{c(1)}", lambda: f"{d(2)}.{d(3)}.{d(3)}-{c(1)}", lambda: f"X{d(7)}{c(1)}", lambda: f"Y-{d(7)}-{c(1)}"],
            "fr": [lambda: f"{self.pick('12')}{d(14)}", lambda: f"{self.pick('12')} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}", lambda: f"{self.pick('12')}.{d(2)}.{d(2)}.{d(2)}.{d(3)}.{d(3)}.{d(2)}"],
            "it": [lambda: f"{c(6)}{d(2)}{c(1)}{d(2)}{c(1)}{d(3)}{c(1)}", lambda: f"{c(3)} {c(3)} {d(2)}{c(1)}{d(2)} {c(1)}{d(3)}{c(1)}", lambda: f"C{c(1)}{d(5)}{c(2)}"],
            "nl": [lambda: d(9), lambda: f"{d(3)} {d(3)} {d(3)}", lambda: f"{d(4)}.{d(2)}.{d(3)}"],
        }
        return self.pick(forms[lang])()

    def number(self) -> str:
        n = self.r.randint(1, 199)
        return self.pick([f"{n}", f"{n}", f"{n}{self.pick('abc')}", f"{n}-{n + 2}"])

    def address(self, lang: str) -> str:
        w, p, n = lambda: self.pick(STREET) if self.r.random() < 0.5 else self.word(2, 3).capitalize(), self.pick, self.r.randint(1, 199)
        if lang == "en":
            s = (self.pick(STARTS) + self.pick(["gate", "moor", "mere", "field", "by", "cote"]) if self.r.random() < 0.7 else p(["Old ", "New ", "Long "]) + w()) + " " + p(["Lane", "Street", "Road", "Rd.", "Court", "Mews", "Hill", "Close", "St.", "Avenue"])
            return p(["", "", "", f"Flat {self.r.randint(1, 9)}, ", f"Unit {self.r.randint(1, 9)}, "]) + f"{self.number()} {s}"
        if lang == "de":
            s = p([lambda: w() + p(["straße", "str.", "weg", "allee", "gasse", "platz", "ring", "ufer", "stieg"]), lambda: w() + p(["straße", "weg", "allee", "ring"]), lambda: f"An der {w()}{p(['mühle', 'straße', 'brücke'])}", lambda: f"Am Alten {w()}{p(['platz', 'hof', 'weg'])}"])()
            return f"{s} {p([self.number(), self.number(), f'{n}/{self.r.randint(1, 9)}'])}"
        if lang == "fr":
            return f"{n}{p(['', ' bis', ' ter'])}{p(['', ','])} {p(['rue', 'bd', 'avenue', 'place', 'impasse', 'chemin', 'quai', 'allée'])} {p(['des ' + w() + 's', 'de la ' + w(), 'du ' + w() + ' ' + w(), 'des ' + p(['Deux', 'Trois']) + ' ' + w() + 's', 'des ' + w() + 's-' + w() + 's'])}"
        if lang == "es":
            return f"{p(['Calle', 'C/', 'Avda.', 'Paseo', 'Plaza', 'Camino'])} {p(['de la ' + w(), 'del ' + w(), 'de los ' + w() + 'es', w() + ' ' + w(), 'del ' + w() + ' ' + w()])}{p([' ', ', ', ', n.º '])}{n}"
        if lang == "it":
            return f"{p(['Via', 'viale', 'Corso', 'Largo', 'P.zza', 'P.zza', 'Vicolo', 'Vicolo', 'Piazza'])} {p(['del ' + w(), 'degli ' + w(), 'della ' + w(), w() + ' ' + w(), 'dei ' + w() + ' ' + w()])}{p([' ', ', ', ' n. '])}{n}{p(['', '', '/B', '/A'])}"
        return f"{p(['', '', '', 'Achter de '])}{w()}{p(['straat', 'kade', 'gracht', 'plein', 'weg', 'dijk', 'laan'])} {n}{p(['', '', self.pick('abc'), '-II', '-I'])}"

    def plain(self, kind: str) -> str:
        r = self.r
        if kind == "company":
            base = self.word(2, 3).capitalize() if r.random() < 0.6 else self.surname()
            return base + " " + self.pick(["GmbH", "AG", "Ltd", "S.p.A.", "S.L.", "B.V.", "SAS", "Group", "Partners", "Solutions", "Consulting", "S.A.", "& Partner"])
        if kind == "product":
            return self.pick([self.pick(SOFTWARE), self.word(2, 4).capitalize() + self.pick(["soft", "ware", "hub", "io", "base", "ly", "max", "sys", "", "", ""])])
        if kind == "job":
            return self.pick(["Data", "Backend", "Frontend", "Embedded", "Database", "Integration", "Field Service", "Key Account", "Cloud", "Sales", "Machine Learning", "Stage", "Payments", "Network", "E-Commerce", "E-Commerce", "Customer Success", "Business Development", "Quality Assurance", "Night", "Ferry", "Channel Partner"]) + " " + self.pick(["Engineer", "Manager", "Architect", "Consultant", "Carpenter", "Specialist", "Porter", "Captain", "Analyst", "Coordinator", "Developer"])
        if kind == "city":
            return self.pick(CITY)
        if kind == "n":
            return str(r.randint(1, 60))
        if kind == "year":
            return str(r.randint(1955, 2025))
        if kind == "date":
            return f"{r.randint(1, 28)}.{r.randint(1, 12)}.202{r.randint(4, 8)}"
        if kind == "money":
            return f"{r.randint(30, 99)}.000"
        return self.pick([f"{self.caps(3)}{self.digits(r.randint(4, 6))}", f"{self.caps(r.randint(2, 3))}-{self.digits(r.randint(3, 6))}", f"{self.digits(r.randint(3, 5))}/{self.digits(2)}", f"202{r.randint(3, 6)}-{self.digits(5)}", f"202{r.randint(3, 6)}-{self.digits(4)}"])

    def marked(self, kind: str) -> tuple[str, str | None]:
        if kind in TITLES:
            return self.pick(TITLES[kind]), None
        if kind in ("name", "last"):
            return (self.name() if kind == "name" else self.last()), "name"
        if kind in ("email", "phone"):
            return getattr(self, kind)(), kind
        what, lang = kind.split("_")
        return (self.id(lang), "id_number") if what == "id" else (self.address(lang), "address")


_WORD = re.compile(r"[^\W\d_]{3,}")


def sentence(pattern: str, fill: Filler, noise: float = 0.0, words: list[str] | None = None) -> tuple[str, list[tuple[int, int, str]]]:
    """The pattern with its places filled; with `noise` that share of its own words gives way to others of `words`, in the same case."""

    def other(m: re.Match) -> str:
        if fill.r.random() >= noise:
            return m.group()
        word = fill.pick(words)
        return word[0].upper() + word[1:] if m.group()[0].isupper() else word

    out, spans = "", []
    for piece in re.split(r"(\{\w+\}|<<\w+>>)", pattern):
        if piece.startswith("{"):
            value, kind = fill.marked(piece[1:-1])
            if kind:
                spans.append((len(out), len(out) + len(value), kind))
            out += value
        else:
            out += fill.plain(piece[2:-2]) if piece.startswith("<<") else _WORD.sub(other, piece) if noise else piece
    return out, spans


def marked_patterns(lang: str) -> list[str]:
    """Every sentence with personal data that the wording of a language gives, in a fixed order."""
    w = WORDS[lang]
    who = ["{name}", f"{{title_{lang}}} {{last}}"]
    pins = [f"{p} {{id_{lang}}}" for p in w["pinned"]]
    out = [a + " " + x + r + "." for i, a in enumerate(w["ask"]) for j, r in enumerate(w["reach"]) for x in (who[(i + j) % 2],)]
    out += [f"{a} {{{k}}}" for a in w["ask"] for k in ("email", "phone")]
    out += [*w["told"], *w["told"]]
    out += [f.replace("{pin}", p).replace("{addr}", f"{{addr_{lang}}}").replace("{lives}", w["lives"][(i + j) % len(w["lives"])]) for i, f in enumerate(w["file"]) for j, p in enumerate(pins)]
    out += [f"{{name}}, {l} {{addr_{lang}}}." for l in w["lives"]]
    out += [f"{a} <<company>>, {c}{{name}}, {{addr_{lang}}}, <<city>>." for a in w["where"][:3] for c in ("", "c/o ", "att. ")]
    out += [p + "." for p in pins]
    out += [f"{a} {{addr_{lang}}}{e}" for a in w["where"] for e in w["after"]]
    out += [f"{c}{s}\n{{name}}{e}" for c in w["close"] for s in ("", ",") for e in ("", "\n{phone}", "\n{email}", "\n<<company>>\n{phone}\n{email}")]
    return out


def vocabulary(lang: str) -> list[str]:
    """The words of the sentences of a language, as they are written there."""
    text = " ".join([*PLAIN[lang], *(s for k in ("told", "file", "ask", "where") for s in WORDS[lang][k])])
    return sorted(set(_WORD.findall(re.sub(r"\{\w+\}|<<\w+>>", " ", text))))


def loose(words: list[str], slots: list[str], fill: Filler) -> str:
    """A string of words in no order with places among them: what is left to tell a place by is its own shape."""
    out = [fill.pick(words) for _ in range(fill.r.randint(2, 9))]
    for s in slots:
        out.insert(fill.r.randint(0, len(out)), s)
    out[0] = out[0] if out[0][0] in "{<" else out[0][0].upper() + out[0][1:]
    return "".join(w + (fill.pick([" ", " ", " ", " ", ", ", ": "]) if i < len(out) - 1 else fill.pick([".", ".", "", "?"])) for i, w in enumerate(out))


def labelled(fills: int = 3, seed: int = 11, held: int | None = None, only: bool = False) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """The table: every sentence with personal data `fills` times, between sentences without, in short texts of one language.

    With `held` (0-4) a fifth of the wordings - by their words, so whole lead-ins and frames - is left out, or with `only`
    nothing else is used.
    """
    fill = Filler(seed)

    def taken(pattern: str) -> bool:
        words = re.sub(r"\{\w+\}|<<\w+>>|\W", "", pattern.split(" {")[0])
        return held is None or (sum(map(ord, words)) % 5 == held) == only

    words = {lang: vocabulary(lang) for lang in WORDS}
    pool = [(lang, p) for lang in WORDS for p in marked_patterns(lang) if taken(p) for _ in range(fills)]
    if not only:
        pool += [(lang, loose(words[lang], fill.pick([["{name}"], ["{name}"], ["{name}"], ["{name}", "{name}"], [f"{{title_{lang}}} {{last}}"], [f"{{addr_{lang}}}"], ["{name}", "{phone}"]]), fill)) for lang in WORDS for _ in range(LOOSE * fills)]
    fill.r.shuffle(pool)
    rows, text, spans = [], "", []

    def add(pattern: str, joint: str) -> None:
        nonlocal text
        s, found = sentence(pattern, fill, 0.4 if not only and fill.r.random() < 0.35 else 0.0, words[lang])
        if not found and fill.r.random() < 0.06:
            s = fill.pick([str.upper, str.lower, str.title])(s)
        if text:
            text += joint
        spans.extend((a + len(text), b + len(text), k) for a, b, k in found)
        text += s

    def plain(lang: str) -> str:
        return loose(words[lang], [fill.pick(["<<job>>", "<<product>>", "<<city>>", "<<company>>", "<<n>>", "<<product>>"]) for _ in range(fill.r.randint(0, 3))], fill) if fill.r.random() < 0.45 else fill.pick(PLAIN[lang])

    for i, (lang, pattern) in enumerate(pool):
        style = fill.pick(["plain", "plain", "plain", "html", "bullet"])
        joint = {"plain": fill.pick([" ", "\n", "\n\n", "\r\n"]), "html": fill.pick(["</p> <p>", "<br>", "</p>\n<p>", "</li><li>"]), "bullet": fill.pick(["\n- ", "\n* ", "\n• "])}[style]
        for _ in range(fill.r.randint(0, 3)):
            add(plain(lang), joint)
        add(pattern, joint)
        for _ in range(fill.r.randint(0, 3)):
            add(plain(lang), joint)
        if i % 2 == 1:
            rows.append((text, spans))
            text, spans = "", []
    if text:
        rows.append((text, spans))
    return rows
