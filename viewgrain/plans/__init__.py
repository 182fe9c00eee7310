"""How large intermediate results are kept, sized and laid out in order."""
