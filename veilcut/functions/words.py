"""Word lists that generators draw from; changing one changes the masked values of its categories."""

GIVEN = tuple(
    "Ada Alan Alma Amir Anton Bela Blanche Boris Bruna Cato Cecil Celia Clem Cora Cyrus Dalia Della Edgar Edith Elio Elma Enzo Erna Esther Fadil Flora "
    "Gareth Gilda Greta Hector Hilda Holger Ida Igor Ilse Imre Ingrid Iris Jasper Joan Jonah Juno Kaspar Kira Lars Leda Lionel Lorna Magnus Mara Mavis Milo "
    "Mona Nadia Nestor Nina Olga Orson Otis Pavel Pearl Petra Quentin Ralph Renata Rhea Roland Rufus Selma Silas Sven Tessa Theo Una Ursula Vera Viktor Wanda Wilma Yara Yves Zelda Zeno".split()
)
SURNAME = tuple(
    "Abbott Adair Aldous Archer Ashby Barlow Baxter Birch Blake Bowen Brandt Burke Calder Carver Chase Clay Cobb Crane Dale Darrow Dean Drake Dunn Easton Ellis "
    "Farrow Finch Flint Frost Gale Garner Gibbs Glover Gray Hale Hardy Hawke Heath Hobbs Holt Hull Irving Jarvis Kane Keane Kemp Kerr Lane Larkin Lowell Marsh "
    "Mercer Mills Moss Nash North Oakes Orr Page Parr Pike Poole Quill Rand Reeve Rhodes Rowe Sharp Shaw Slade Snow Stone Swift Tate Thorne Tripp Vance Vaughn Wade Webb West Wilde Wynn Yates".split()
)
STREET = tuple("Acorn Amber Apple Barley Beacon Bell Brook Canal Castle Cedar Chapel Church Clover Copper Cotton Fern Field Garden Granite Harbor Hazel Hill Lake Laurel Lemon Linden Maple Meadow Mill Oak Orchard Park Pearl Pine Quarry River Rose Spring Station Summit Valley Willow".split())
SUFFIX = ("Alley", "Avenue", "Court", "Drive", "Lane", "Place", "Road", "Square", "Street", "Terrace", "Way")
FILLER = tuple("amount basis batch belt board branch bridge channel chart circle class corner cover curve detail draft edge engine entry figure file fold frame front glass grade grid group guide hinge issue joint label layer ledger level lever line link list margin mark mesh model motor note order panel part path phase plan plate point range rate ratio record ring round scale scope sheet shelf slot space stage step stock strip table term tile tool track tray unit value view wall wheel wing zone".split())
HOSTS = ("example.com", "example.net", "example.org")
AREAS = tuple(str(n) for n in (201, 202, 203, 205, 206, 207, 208, 209, 210, 212, 213, 214, 215, 216, 217, 218, 219, 224, 225, 228, 229, 231, 234, 239, 240, 248, 251, 252, 253, 254))
