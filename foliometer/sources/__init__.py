"""Reading and writing the product's tables, files and event feeds."""
