"""Labelled training talk, all of it invented here: calls with speakers, stamps, sounds, fillers and personal data.

A record is a list of pieces (text, tag, kind): the tag is what the token tagger of problem 6 is to say (speaker, stamp,
annotation, filler or speech), the kind what the entity tagger of problem 4 is to say (or "" for none). Names and addresses
are made of syllables, so a model can't learn them by heart and has to go by what is said around them.
"""

import random
import re

TAGS = ["speech", "speaker", "stamp", "annotation", "filler"]
KINDS = ["email", "phone", "id_number", "address", "name"]

_ON, _MID = "b br c d dr f fr g gr h j k l m n p qu r s sh st t th tr v w y z".split(), "a e i o u ai ea ia ou".split()
_OFF = "n r l s m x nd ck th rn lla na ra mo ven dor wyn las ric bel".split()
#: Given names that are also things, for both readings.
_THINGS = "hazel ivy rowan iris jasper ash robin clay dale heath olive ruby amber wren linden sable".split()
_PLACES = "gate hall yard bay dock market bridge mill harbour station terrace point".split()
_STREETS = "Street St Avenue Ave Road Rd Lane Ln Way Boulevard Blvd Drive Dr Court Ct Terrace Place Square Close Crescent Row Quay".split()
_NUMBERS = "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty ninety".split()
_DIGITS = "zero oh one two three four five six seven eight nine".split()
_TITLES = "Mr Mrs Ms Miss Dr Captain Mr. Mrs. Ms. Dr. Professor".split()
_MONTHS = "January February March April May June July August September October November December".split()
_DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()

#: {n} name, {g} given name, {e} email, {p} phone, {i} identity number, {a} address; the other slots are no personal data.
PERSONAL = """good morning, this is {n}, how can I help
good afternoon, this is {n}, what can I do for you
hello, this is {n} speaking
hi there, {n} speaking
hi there, this is {n}, thanks for waiting
you're through to {n} on the service desk
you're through to {n} on the night desk
you're speaking to {n} in accounts
my name is {n}
{n} here, {a}, phone {p}
{n} here, {a}
{n} here, phone {p}
{n} here from the depot
hello, {n} here, my number is {p}
it's {n} here, I rang before
I spoke to {n} last week about this
I spoke to {n} on {day} about the same thing
I talked to {n} yesterday
my neighbour {n} has the spare key
my colleague {n} has the form
my sister {n} will be in
it's under {n}, that's the account holder
it's booked under {n}, I think
the account holder is {n}
the name on the account is {n}
so that's {n}, {e}, and the ID {i}
so that's {n}, {p}, and the ID {i}
so I have {n}, {a}, and the number {p}
so that's {n}, {e}, and the phone {p}
thanks {g}, that's kind
please ask {n} to ring me
{n} will sign for it
could you tell {n} that I called
my email is {e} if that's easier
my email is {e}
my email address is {e}, all small letters
send it to {e}, or copy {e}
send the invoice to {e} please
I've got {e} on file, is that still good
is {e} still the right one
you can write to {e}
it's {e}, no blanks
call me on {p} or at work, {p}
call me on {p}
ring me back on {p} after lunch
best number is {p}
the best number is {p}
my number is {p}
and the phone ending, let me see, {p}, is yours
I have {p} down for you
the mobile is {p}, the office {p}
my ID? it says {i} on the card
my ID is {i}
the insurance number is {i}
my insurance number, that's {i}
for security, was the social {i}
for security, I need the social, {i}
the passport says {i}
could you confirm {i} for me
deliver to {a}, round the back
deliver it to {a}
please send it to {a}, side door
the address I have is {a}, correct
the address I have is {a}
we're at {a}
we live at {a}
I'm at {a}, first floor
the new address is {a}
you have me at {a}""".split("\n")

PLAIN = """that would be ${n4} all in
so that would be ${n3} all in
that comes to ${n5}.50 with the surcharge
thanks for calling, take care
bye now
anything else just ring us
I need to tell you the fee schedule may change with thirty days' notice
before we go on, this line is kept for training and quality
okay, fine, thanks
alright then
right
okay
sure, go on
yes please
some time after four
before eleven suits me best
hello, service desk, what can I do for you
hello, front desk, what can I do
thanks for holding, how can I help today
great, it's gone through, you're all set
there we go, that's sorted on my screen now
that's brilliant, made my day
you've been a real help, cheers
room {n2}, second floor, past the lift
room {n3}, first floor, by the stairs
the number on the crate is {n3}.{n4}.{n3}
your reference is HB-{n5}-{n2}
your reference is {n6}
the docket says {n3}-{n2}-{n3}, does that help
about {n1}:30, maybe a bit later
the {thing} wood trim has gone green
the left hinge on the {thing} finish frame snapped
it came off the {thing} pattern frames
the {thing} handle is loose
a {thing} coloured lens would do
I've set the reminder for 2024-{n2}-{n2}
will it be ready by May, or June at the latest
you know the place better than I do
ticket {n5}, I wrote it on the back of the box
my ticket is {n5}
the sort of rope you gave us last year was fine
it's the kind of thing that happens
what kind of lens is it
I know what you mean
no, I mean the second bay, not the first
you see the gate on the left
it's order {n4}-{n3}, from the 3rd of May
order {n7} hasn't come
I'm fed up with ringing about this
tracking is 1Z{n9}, it left the depot at {n1}
is that the model MX-{n3}-{n4} on the label
there's a grace period of ten days on that
we post that on the board as @{word}_desk every Friday
follow us at @{word} for news
let me pull that up, bear with me one second
the part number is {n3}-{n4}, it's stamped on the lid
part {n7} is out of stock
the part number is {n3}-{n4},
that part, number {n3}-{n4}
the docket number is {n3}-{n4}
the model number is {n3}-{n4}
serial number {n3}-{n4}, I think
the {place} desk closes at 16:45 today
the {place} Nine desk closes at 17:30 today
I'll read it back, {n4} boxes, {n2} pallets
it's been {n1} weeks since the {n1} o'clock visit
version {n1}.{n1}.{n2} of the app, if that matters
could you give me the order number please
I'm at the {Place} depot, by the {Place} cafe
we were at {Place} Point on {day} and it was shut
yes, serial {n4} {n4}, and then a letter
the serial is {n8}
there are {n2} of us on the same pontoon
it looks like the old one (the grey one) is still there
the small box (with the blue lid) is mine
he said (I wrote it down) it was free
do you know what time the driver came
I have to say this has been a poor show
I've been charged twice for the same week I think
over lunch is fine
what is this handling fee, nobody told me about it
only once I'm home, after seven
there's a line on my statement I can't make sense of
if you know the extension, dial it now
your call is in a queue, the wait is about four minutes
thank you for calling, press one for bookings or two for accounts
our office hours are eight to six, {day} to {day}
we'll check in again once the crew has been
I've put a note in the diary to ring you back
put me through to your boss
I'm passing this up to the duty lead right away
I'll have it with you by {month} {n2}
can I speak to whoever is in charge please
it was meant to be here on {day} and there's no sign of it
{Place} {Place} quoted me less for the same thing
{Place} Holdings quoted me less
this one goes to the second desk, they'll own it
we waited the whole morning and nobody turned up
I don't want to sign for that many months
whenever really, I'm around
that's a lot of money for what it is
she's coming out of the water for the cold months
lovely, I've added it and the first month starts today
it turned up cracked right down one side
one corner is crushed and the wrapping is split
the chilled racks near door six
forty pallets sitting in the plus-two chamber
can we swap the date to something after the {n2}th
we're on the yellow buoy, not a pontoon
we're at the yard until six
I'm on shift until ten
please deliver to the side gate
deliver on {day} if you can
this is the third time I ring
this is about the gate
so that's two boxes and a lid
so that's all for now
my email never came
my number is on the form
I spoke to someone last week
I spoke to your boss about it
it's under the counter
call me on {day}
send it to the office
that week is no good, we're away until the 20th
five or six of them, maybe seven
one two three, it works
I said twelve, not twenty
the code is {n4} and then the hash key
the gate code {n4} stopped working
we measured {n2} by {n3}
the fee of {n2} dollars
my {thing} tree is in the way
my neighbour has the spare key
the account holder is away
last time your crew left the place in a right state
there's a pump howling outside at two in the morning
a full year is a long time to be tied in
honestly that's more than I was hoping to spend
here is the thing: it never worked
my point: nobody came
two things: the gate and the light
so - where were we
the lift - the big one - is stuck
—""".split("\n")

#: {w} is a person or a place named elsewhere in the call; only the other mention tells which.
UNCLEAR = """it's {w} again
I asked for {w}
about {w}, yes
and {w}, did that come to anything
that was {w}, I think
{w}, as I said
I said {w} before
not {w}, the other one
{w} never rang back
we had {w} last year
is that {w} or not
{w}, right""".split("\n")

_HESITATIONS = ["uh", "uhh", "uhm", "um", "umm", "ummm", "er", "erm", "hmm", "hm", "mm", "ah", "eh", "ehm", "Um", "Uh", "Er", "Erm", "Hmm", "Uhm"]
_PHRASES = ["you know", "I mean", "kind of", "sort of", "you see"]
_SOUNDS = ["music", "hold music", "pause", "silence", "sighs", "sigh", "unclear", "cough", "coughs", "coughing", "laughs", "laughter", "beep", "dog barking", "a dog barking", "noise", "background noise", "crosstalk", "static", "typing", "inaudible",
           "line cuts out", "door slams", "background voices", "sneezes", "clears throat", "phone ringing", "applause", "breathing", "indistinct", "overlapping", "chuckles", "sniffs", "wind", "traffic", "baby crying", "whispering"]
SPEAKER_WORDS = {
    "AGENT": ["Agent", "Agt", "Agnet", "Advisor", "Adviser", "Rep", "Representative", "CSR", "Operator", "Service rep", "AGENT"],
    "CUSTOMER": ["Customer", "Cust", "Custmer", "Client", "Caller", "CUSTOMER"],
    "IVR": ["IVR", "System", "Recording", "Automated voice", "Auto-attendant"],
}


class Talk:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.people, self.spot = [self.given(), self.family()], self.place()

    def one(self, x):
        return self.r.choice(x)

    def syllables(self, least: int = 1, most: int = 2) -> str:
        return "".join(self.one(_ON) + self.one(_MID) for _ in range(self.r.randint(least, most))) + self.one(_OFF)

    def given(self) -> str:
        return (self.one(_THINGS) if self.r.random() < 0.12 else self.syllables()).capitalize()

    def family(self) -> str:
        x, u = self.syllables().capitalize(), self.r.random()
        if u < 0.06:
            return self.one([f"O{self.one(chr(39) + '’')}{x}", f"de{x}", f"Mc{x}", f"D'{x}"])
        return f"{x}-{self.syllables().capitalize()}" if u < 0.12 else self.syllables(1, 2).capitalize() + self.one(["", "", "man", "feld", "quist", "ston", "mere"])

    def name(self) -> list:
        u, g, f = self.r.random(), self.given(), self.family()
        if u < 0.4:
            return [(g, "name")]
        if u < 0.7:
            return [(f"{g} {f}", "name")]
        if u < 0.78:
            return [(f"{f}, {g}", "name")]
        if u < 0.88:
            return [(f"{g} {chr(65 + self.r.randrange(26))}. {f}", "name")]
        return [(f"{self.one(_TITLES)} ", ""), (f, "name")]

    def domain(self) -> list[str]:
        w = self.one([self.syllables(), self.syllables() + self.one(["mail", "post", "box", "office"]), self.one(["mailbox", "lists", "post", "quay-office", "team"])])
        return [w, *([self.syllables()] if self.r.random() < 0.25 else []), self.one(["test", "example", "invalid", "com", "org", "net"])]

    def email(self) -> list:
        g, f, d = self.given().lower(), self.family().lower().replace("’", "'"), self.domain()
        f = f.replace("'", "")
        local = self.one([g, f"{g}.{f}", f"{g}_{f}", f"{f}_{g}", f"{g[0]}{f}", f"{g}{self.r.randrange(100):02d}", f"{g}+{self.one(['orders', 'home', 'bills'])}", f"{f}.{g}", f"{g}-{f}"])
        u = self.r.random()
        if u < 0.6:
            x = f"{local}@{'.'.join(d)}"
        elif u < 0.7:
            x = f"{local} @ {'.'.join(d)}"
        elif u < 0.75:
            x = f"{local} {self.one(['[at]', '(at)'])} {'.'.join(d)}"
        else:
            say = lambda s: s.replace(".", " dot ").replace("_", " underscore ").replace("-", " dash ").replace("+", " plus ")
            x = f"{say(local)} at {say('.'.join(d))}"
        return [(x.upper() if self.r.random() < 0.04 else x, "email")]

    def digits(self, n: int) -> str:
        return "".join(str(self.r.randrange(10)) for _ in range(n))

    def phone(self) -> list:
        a, b, c, u = f"{self.r.randrange(200, 999)}", self.one(["555", self.digits(3)]), self.digits(4), self.r.random()
        s = self.one([" ", "-", ".", ""])
        if u < 0.2:
            x = f"({a}) {b}-{c}"
        elif u < 0.45:
            x = s.join([a, b, c])
        elif u < 0.6:
            x = f"{b}-{c}"
        elif u < 0.7:
            x = self.one(["+1", "1"]) + self.one([" ", "-"]) + self.one([" ", "-", "."]).join([a, b, c])
        elif u < 0.85:
            x = self.one(["+44 1632 ", "01632 ", "+44 ", "0"]) + self.one([self.digits(6), self.digits(3) + " " + self.digits(3)])
        else:
            x = self.one([" ", ", ", " "]).join(self.one(_DIGITS) for _ in range(self.one([7, 10])))
        return [(x + (f" {self.one(['ext', 'ext.', 'extension', 'x'])} {self.digits(2)}" if self.r.random() < 0.08 else ""), "phone")]

    def identity(self) -> list:
        s, cap = self.one([" ", "-", "", "."]), lambda n: "".join(chr(65 + self.r.randrange(26)) for _ in range(n))
        return [(self.one([s.join([self.digits(3), self.digits(2), self.digits(4)])] * 3 + [s.join([cap(2), self.digits(2), self.digits(2), self.digits(2), self.one("ABCD")]), cap(1) + self.digits(8), self.one("XYZ") + self.digits(7) + cap(1)]), "id_number")]

    def place(self) -> str:
        return self.one([self.syllables(), self.syllables() + self.one(["mark", "water", "ford", "fern", "side", "wood"]), self.one("Sextant Tannery Chapel Orchard Station Mill Cooper Rope Salt Anchor Lantern".split())]).capitalize()

    def address(self) -> list:
        n = str(self.r.randrange(1, 1500)) + (self.one("ABCD") if self.r.random() < 0.1 else "") if self.r.random() < 0.8 else self.one(_NUMBERS)
        x = f"{n} {self.place()} {self.one(_STREETS)}{'.' if self.r.random() < 0.08 else ''}" if self.r.random() < 0.95 else f"{n} {self.place()} {self.place()} {self.one(_STREETS)}"
        if self.r.random() < 0.25:
            x += f", {self.one(['Apt', 'Unit', 'Flat', 'Suite'])} {self.r.randrange(1, 99)}"
        if self.r.random() < 0.4:
            x += f", {self.place()}" + (" " + self.one([self.place(), *_PLACES, "Sound", "Bridge", "Green", "Hill", "Bay"]).capitalize() if self.r.random() < 0.3 else "") + (f" {self.digits(5)}" if self.r.random() < 0.6 else "")
        return [(x, "address")]

    def fill(self, template: str) -> list:
        makers = {"n": self.name, "g": lambda: [(self.given(), "name")], "e": self.email, "p": self.phone, "i": self.identity, "a": self.address}
        out, rest = [], template
        while "{" in rest:
            before, _, rest = rest.partition("{")
            slot, _, rest = rest.partition("}")
            out.append((before, ""))
            if slot in makers:
                out += makers[slot]()
            elif slot[0] == "n":
                out.append((self.digits(int(slot[1:])), ""))
            elif slot == "w":
                out.append(self.one([(self.people[0], "name"), (self.spot, "")]))
            else:
                out.append(({"thing": self.one(_THINGS), "place": self.one(_PLACES), "Place": self.spot if self.r.random() < 0.5 else self.place(), "word": self.syllables(), "day": self.one(_DAYS), "month": self.one(_MONTHS)}[slot], ""))
        return [p for p in [*out, (rest, "")] if p[0]]

    def words(self, pieces: list) -> list:
        """Pieces cut before blanks and where the kind changes: (text with the blank before it, kind)."""
        text, kinds, out = "".join(t for t, _ in pieces), [k for t, k in pieces for _ in t], []
        for m in re.finditer(r" ?[^ ]+", text):
            start = m.start()
            for i in range(m.start() + 1, m.end() + 1):
                word = m.start() + (m[0][0] == " ")
                if i == m.end() or (i > word and kinds[i] != kinds[i - 1]):
                    out.append((text[start:i], kinds[i - 1]))
                    start = i
        return out

    def noisy(self, words: list, rough: float) -> list:
        """(text, tag, kind): the words with set phrases between them, and hesitations, sounds and stamps between all these."""
        said = []
        for i, (w, kind) in enumerate(words):
            if w[0] == " " and i and (not kind or words[i - 1][1] != kind) and words[i - 1][0][-1:].isalnum() and self.r.random() < 0.04 * rough:
                first, *rest = self.one(_PHRASES).split(" ")
                said += [(",", "speech", ""), (" " + first, "filler", ""), *((" " + x, "filler", "") for x in rest), (",", "filler", "")]
            said.append((w, "speech", kind))
        out = []
        for i, (w, tag, kind) in enumerate(said):
            before = len(out)
            if w[0] == " " or i == 0:
                u = self.r.random()
                if u < 0.1 * rough:
                    out.append((" " + self.one(_HESITATIONS) + self.one(["", "", ",", "...", "…"]), "filler", ""))
                    if self.r.random() < 0.15:
                        out.append((" " + self.one(_HESITATIONS) + self.one(["", ",", "..."]), "filler", ""))
                elif u < 0.14 * rough:
                    out.append((" " + self.sound(), "annotation", ""))
                elif u < 0.155 * rough:
                    out.append((" " + self.one([f"({self.clock(1)})", f"[{self.clock(2)}]", f"[{self.clock(3)}]"]), "stamp", ""))
            out.append(((" " if len(out) > before and w[0] != " " else "") + w, tag, kind))
        if self.r.random() < 0.1 * rough:
            out.append((" " + self.one(_HESITATIONS) + self.one([",", "...", ""]), "filler", ""))
        if self.r.random() < 0.03 * rough:
            out.append((" " + self.sound(), "annotation", ""))
        return out

    def sound(self) -> str:
        s = self.one(_SOUNDS) + (f" {self.r.randrange(2)}:{self.r.randrange(60):02d}" if self.r.random() < 0.1 else "")
        s = self.one([s, s, s, s.upper(), s.capitalize()])
        return self.one([f"[{s}]", f"({s})", f"(({s}))", f"{{{s}}}", f"<{s}>", f"<{s}/>", f"*{s}*", f"♪ {s} ♪"])

    def clock(self, form: int) -> str:
        m, s = self.r.randrange(6), self.r.randrange(60)
        return [f"{m}:{s:02d}", f"{m:02d}:{s:02d}", f"00:{m:02d}:{s:02d}"][form - 1]

    def call(self, turns: int, personal: float = 0.4) -> list[list]:
        """One call: records of pieces (text, tag, kind) in one style of stamps, labels and letter case."""
        stamp = self.one([None] * 3 + ["[3]", "(1)", "[2]", "<m>", "3 -", "3"])
        label = self.one([None] * 3 + ["{}:", ">> {}:", "[{}]", "<{}>", "{} -", "[{}]:"])
        case, rough = self.one([None] * 6 + ["upper", "lower", "lower"]), self.one([0.3, 1, 1, 2])
        self.people, self.spot = [self.given(), self.family()], self.place()
        out = []
        for _ in range(turns):
            is_personal = self.r.random() < personal
            pieces = self.fill(self.one(UNCLEAR if self.r.random() < 0.06 else PERSONAL if is_personal else PLAIN))
            if self.r.random() < 0.25:  # people come up again
                pieces = [(self.one([self.people[0], " ".join(self.people)]) if k == "name" and ", " not in t else t, k) for t, k in pieces]
            if self.r.random() < 0.5:
                pieces[0] = (pieces[0][0][:1].upper() + pieces[0][0][1:], pieces[0][1])
            w = self.words(pieces)
            if self.r.random() < 0.5:
                w.append((self.one([".", ".", "?", ","]), ""))
            parts = [w]
            gaps = [i for i in range(1, len(w)) if w[i][0][0] == " "]
            if gaps and self.r.random() < 0.2:
                c = self.one(gaps)
                tail = [(w[c][0].strip(), w[c][1]), *w[c + 1 :]]
                parts = [w[:c] + ([(".", "")] if self.r.random() < 0.4 else []), tail]
            for part in parts:
                body = self.noisy(part, rough)
                if self.r.random() < 0.04:
                    body = [(self.sound(), "annotation", "")]
                head = []
                if stamp and self.r.random() < 0.95:
                    c = self.clock(int(stamp[1])) if stamp[0] in "[(" else None
                    head.append(({"[": f"[{c}]", "(": f"({c})", "<": f"<{self.r.randrange(4)}m{self.r.randrange(60):02d}s>", "3": self.clock(3) + (" -" if stamp == "3 -" else "")}[stamp[0]], "stamp", ""))
                if label and self.r.random() < 0.85:
                    name = self.one(self.one(list(SPEAKER_WORDS.values())))
                    name = self.one([name, name, name.lower(), name.upper(), f"{name} {self.r.randrange(1, 4)}"])
                    head.append(((" " if head else "") + label.format(name), "speaker", ""))
                if head and body:
                    body[0] = (" " + body[0][0].lstrip(), *body[0][1:])
                else:
                    body = [(body[0][0].lstrip(), *body[0][1:]), *body[1:]] if body else body
                record = head + body
                if case:
                    record = [(getattr(t, case)(), tag, kind) for t, tag, kind in record]
                out.append(record)
        return out


def labelled(record: list) -> tuple[str, list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The raw text, its spans by tag, and its items by kind (what noise cuts apart is one item)."""
    text, tags, items = "", [], []
    for t, tag, kind in record:
        tags.append((len(text), len(text) + len(t), tag))
        if kind:
            start = len(text) + len(t) - len(t.lstrip())
            # a new item begins where the kind changes, or where the pieces were apart in the template
            if items and items[-1][2] == kind and items[-1][3]:
                items[-1] = (items[-1][0], len(text) + len(t), kind, True)
            else:
                items.append((start, len(text) + len(t), kind, True))
        elif tag == "speech" and items:
            items[-1] = (*items[-1][:3], False)
        text += t
    return text, tags, [i[:3] for i in items]
