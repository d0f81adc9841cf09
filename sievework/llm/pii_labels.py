"""The labelled table the chain model is trained on.

Each line marks its spans as ``{kind:text}``; a 0 stands for a digit that is drawn anew for every copy, so the model
learns shapes and not numbers.  Lines without marks are examples of numbers that are not personal data.
"""

from __future__ import annotations

import random
import re

COPIES = 4

LINES = """
call me at {phone:+0 (000) 000-0000} after noon
reach the office on {phone:+00 00 0000 0000} any day
my number is {phone:+000 000 000 000} thanks
the line {phone:+0-000-000-0000} was busy
ring {phone:(000) 000-0000} for the desk
she left {phone:(000) 000-0000} on the note
phone: {phone:000-000-0000} or by post
fax {phone:000-000-0000} is still on
dial {phone:000.000.0000} and wait
mobile {phone:000.000.0000}
tel {phone:000 0000 0000} in the morning
telefon {phone:0000 000000} bitte
tel. {phone:00 00 00 00 00} le soir
llame al {phone:000 000 000} por favor
write to {email:name.surname@mail.example.com} today
mail {email:xy00@host0.example.org} or call
send it to {email:info@example.net}. thanks
contact: <{email:a.b-c@sub.example.co.uk}>
kontakt {email:post@beispiel.example}, danke
at {email:user(at)example.com} as before
ask {email:first.last[at]example.org} about it
host {ip:000.000.00.000} did not answer
from {ip:00.0.0.00} to {ip:000.00.0.0} again
the server {ip:000.000.000.000}, then the next
ping {ip:0.0.0.0} failed
card {card:0000 0000 0000 0000} was charged
card no. {card:0000-0000-0000-0000} on file
paid with {card:0000000000000000} last week
los {card:0000000000000000} en casa
the number {card:0000 000000 00000} of the card
und {card:0000000000000000} der schein
word {card:0000000000000000} other {email:ab.00@mail0.example.com} word
word {phone:+0 (000) 000-0000} {ip:000.000.00.00} word
WORD {card:0000000000000000}!! WORD!! MORE!!
see version 0.00.0 of the tool
release 0.0 and 0.0.0 came out
under the licence 00-0.0 and version 0. of it
by license BY-NC 0.0. and later
the public licence, version 0. applies
in 0000 and 0000 the rate fell to 0.0
on 00.00.0000 at 00:00 the train left
on 0000-00-00 we met for 0 hours
the bill of 000.00 and 0,000.00 was paid
about 0,000,000 people in 00 places
pages 000-000 and 00-00 of the book
section 0.0.0 (part 0) and chapter 00
chapter (0) of part [00] shows
isbn 000-0-000-00000-0 of the book
order 000000 and item 0000000 were sent
order id 0000000000 is open
id: 00000 code: 000000
token = "0ab0c00de0f00abc00d0e00f0a0b0c00d0e00f0a" in the file
key a0b00cd0e0f00a0b0c00d00e0f0a0b0c00d0e00ff was set
sha e0f0a00bc0d000a0bf0c00d0 of the commit
temperature of -00.0 or +0 degrees
a gain of +00 % and +0.0 points
0 x 0 = 00 and 0 + 0 = 00
room 000 (floor 0) at 00 o'clock
follow @name and @other_name here
he said @ 00 per kilo
the years 0000-0000 and 0000/0000
call (see below) for the notes [0]
row 00 col 00 value 0000.0000
size 0000x0000 and 000 KB
00. item and 00) item
route 00 to exit 00A and hall B0
flight AB0000 and seat 00C
zip 00000 city and box 0000
amount 000 000 kr in all
0000 000 units and 00 000 more
the code 0000-00 for model X000-0
""".strip().splitlines()

_MARK = re.compile(r"\{(email|ip|card|phone):([^}]*)\}")


def labelled_table() -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, spans) rows; as many copies of each line as ``COPIES``, digits drawn from a fixed seed."""
    draw = random.Random(20)
    rows = []
    for _ in range(COPIES):
        for line in LINES:
            filled = "".join(draw.choice("123456789") if c == "0" else c for c in line)
            text, spans, at = "", [], 0
            for m in _MARK.finditer(filled):
                text += filled[at : m.start()]
                spans.append((len(text), len(text) + len(m[2]), m[1]))
                text += m[2]
                at = m.end()
            rows.append((text + filled[at:], spans))
    return rows
