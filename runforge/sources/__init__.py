"""Reading what runs leave behind, writing what is made of it."""
