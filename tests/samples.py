"""Small tables and texts that several test files share."""

CSV_TEXT = """id,name,age,fare,survived
1,Alice,,10.50,1
2,Bob,25,7.25,0
3,Carol,FORTY,15.00,1
4,Dave,-5,8.00,0
5,Eve,28,512.33,1
6,Frank,45,9.75,0
7,Grace,33,11.50,1
8,Alice,29,6.50,0
9,Ivan,38,13.25,1
10,Judy,22,5.00,0
"""

SCHEMA = "id long, name string, age string, fare double, survived long"


def passenger_rows(fare5=512.33, name8="Alice"):
    return [
        (1, "Alice", None, 10.50, 1),
        (2, "Bob", "25", 7.25, 0),
        (3, "Carol", "FORTY", 15.00, 1),
        (4, "Dave", "-5", 8.00, 0),
        (5, "Eve", "28", fare5, 1),
        (6, "Frank", "45", 9.75, 0),
        (7, "Grace", "33", 11.50, 1),
        (8, name8, "29", 6.50, 0),
        (9, "Ivan", "38", 13.25, 1),
        (10, "Judy", "22", 5.00, 0),
    ]
