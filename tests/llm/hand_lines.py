"""Lines written by hand for the tests, without the generator of the labelled table: text and its mentions."""

LINES = [
    ("Could you forward this to grace.bennett@post.example before Friday?", [("email", "grace.bennett@post.example")]),
    ("My landlord, Daniel Okafor, wants the rent by the first.", [("name", "Daniel Okafor")]),
    ("She moved in with Maria Silva two years ago.", [("name", "Maria Silva")]),
    ("Passport K1234567 was stolen at the airport.", [("identity", "K1234567")]),
    ("O CPF dele é 529.982.247-25.", [("identity", "529.982.247-25")]),
    ("His social security number, 219-09-9999, was printed on the envelope.", [("identity", "219-09-9999")]),
    ("Ring the surgery on 01632 960983 after ten.", [("phone", "01632 960983")]),
    ("Our fax, +1 202 555 0147, has been switched off.", [("phone", "+1 202 555 0147")]),
    ("(415) 555-0132 is the front desk", [("phone", "(415) 555-0132")]),
    ("The bakery at 12 Willow Lane burned down.", [("address", "12 Willow Lane")]),
    ("Flat 3, 27 Victoria Road, Ashford is to let", [("address", "Flat 3, 27 Victoria Road, Ashford")]),
    ("i think peter weber owes me a coffee", [("name", "peter weber")]),
    ("Novak, Hanna; 14 Castle Street", [("name", "Novak, Hanna"), ("address", "14 Castle Street")]),
    ("please write to info at club dot example if you find it", [("email", "info at club dot example")]),
    ("call zero two zero seven nine four six oh nine one one, quick", [("phone", "zero two zero seven nine four six oh nine one one")]),
    ("L. Martin signed the lease.", [("name", "L. Martin")]),
    ("Dr Hanna Weber will operate tomorrow.", [("name", "Hanna Weber")]),
    ("Frau Weber wohnt in der Lindenstraße 8.", [("address", "Lindenstraße 8")]),
    ("Il habite 5 rue du Marché, à côté de la gare.", [("address", "5 rue du Marché")]),
    ("Mi hermana vive en la Calle Mayor 44.", [("address", "Calle Mayor 44")]),
    ("Tax id 98 765 432-10? No, 123-45-6789 is right.", [("identity", "98 765 432-10"), ("identity", "123-45-6789")]),
    ("NI number AB 12 34 56 C, date of birth unknown", [("identity", "AB 12 34 56 C")]),
    ("Lake Superior froze over in January.", []),
    ("Deutsche Bank closed its branch on Friday.", []),
    ("Ticket 20931 was merged into ticket 20877.", []),
    ("The match ended 3-2 after 120 minutes.", []),
    ("Room 204 smells of paint.", []),
    ("We counted one two three and lifted the piano.", []),
    ("Chapter Seven is called Winter Garden.", []),
    ("The release of 2024-05-17 contains 1,204,551 rows.", []),
    ("Order 7781-22 weighs 14.25 kilograms.", []),
    ("Best Regards", []),
    ("The Golden Lion pub opens at 18:30.", []),
    ("commit 8f3a01c touches 12 files", []),
    ("Oxford Street was crowded.", []),
    ("Press two for English or three for Spanish.", []),
    ("El martes no hay clase en la plaza.", []),
    ("Am Montag beginnt die Schule.", []),
    ("http://intranet.example/page?id=55 is down", []),
    ("Version 10.4.2 build 7781 runs on port 8080.", []),
]
