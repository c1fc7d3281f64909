"""A small ledger with known answers."""

CHECKING = """d,t,c,m,s,a,am,b
01/05/2017,Pay,,Salary,Debit,Checking,1000.00,1000.00
01/20/2017,Groceries,,Food,Credit,Checking,-200.00,800.00
03/02/2017,Groceries,,Food,Credit,Checking,-50.25,749.75
01/03/2018,Pay,,Salary,Debit,Checking,1100.00,1849.75
01/15/2018,Groceries,,Food,Credit,Checking,-80.00,1769.75
02/10/2018,To savings,,Transfer,Transfer,Checking,-500.00,1269.75
02/12/2018,Refund,,Food,Debit,Checking,20.00,1289.75
"""

SAVINGS = """Date,Title,Comment,MainCategory,Subcategory,Account,Amount,Balance
02/10/2018,From checking,,Transfer,Transfer,Savings,500.00,500.00
03/31/2018,Interest,,Interest,Debit,Savings,1.50,501.50
03/30/2018,Fee,,Fees,Credit,Savings,-2.00,499.50
"""


def write(folder, **files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)
