"""Small fixed word lists: given names by gender, surnames, units, number words."""

GIVEN_FEMALE = tuple(
    "Alice Amanda Amelia Amy Ana Andrea Angela Anna Barbara Beatrice Camille Carla Caroline Charlotte Clara Claire Diana Elena Elisabeth "
    "Elizabeth Emily Emma Eva Florence Grace Hannah Helen Ines Irene Isabel Jane Jennifer Jessica Julia Karen Kate Katharina Laura Lena "
    "Linda Lisa Louise Lucia Lucy Maria Marie Martha Mary Mia Michelle Nina Nora Olivia Patricia Rachel Rosa Ruth Sandra Sara Sarah Sofia "
    "Sophie Susan Teresa Valerie Victoria".split()
)
GIVEN_MALE = tuple(
    "Adam Albert Alex Andrew Anthony Antonio Arthur Benjamin Bernard Bob Bruno Carlos Charles Christian Christopher Daniel David Diego Edward "
    "Emil Eric Felix Fernando Francis Frank Frederic George Hans Harry Henry Hugo Ivan Jack Jacob James Jan John Jonas Jose Joseph Juan Karl Klaus "
    "Leon Lewis Louis Luca Lucas Luis Marc Mark Martin Matthew Max Michael Miguel Nicolas Oliver Oscar Otto Pablo Patrick Paul Pedro Peter "
    "Philip Pierre Richard Robert Samuel Simon Stefan Stephen Thomas Tim Tom Victor Walter William".split()
)
SURNAMES = tuple(
    "Adler Alvarez Anderson Baker Bauer Becker Bennett Bernard Brandt Brooks Brown Campbell Carter Castillo Clark Cooper Cruz Davies Diaz Dubois "
    "Dupont Edwards Evans Fischer Fisher Fontaine Fournier Garcia Gomez Graham Green Griffin Hall Harris Hoffmann Hughes Jackson Johnson Keller "
    "Koch Lambert Leroy Lewis Lopez Martinez Mason Meyer Miller Moore Moreau Morgan Morris Murphy Neumann Nguyen Ortega Parker Perez Powell "
    "Ramirez Reed Richter Rivera Roberts Robinson Romero Roth Rousseau Sanchez Schmidt Schneider Scott Shaw Silva Simmons Stewart Taylor Torres "
    "Turner Vargas Vogel Wagner Walker Ward Watson Weber White Wilson Winter Wolf Wood Wright Young Zimmermann".split()
)
UNITS = tuple(
    "mm cm m km inch inches ft feet foot yard yards mile miles mg g kg gram grams kilogram kilograms pound pounds lb lbs oz ounce ounces ton tons "
    "ml l liter liters litre litres gallon gallons cup cups second seconds sec minute minutes min hour hours hr hrs day days week weeks month months "
    "year years cent cents dollar dollars euro euros usd eur gbp percent degree degrees celsius fahrenheit kmh mph watt watts volt volts joule joules "
    "meter meters metre metres centimeter centimeters kilometer kilometers".split()
)
NUMBER_WORDS = tuple(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty "
    "forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split()
)
